import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spotweave.llm import queries, substring_dedup


def brute(rows, length):
    """Every window looked for among all that start before it."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first, out = {}, []
    for i in sorted(words):
        w, gone = words[i], set()
        for k in range(len(w) - length + 1):
            if first.setdefault(tuple(w[k : k + length]), (i, k)) != (i, k):
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def corpus(seed, docs=90):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["The", "the", "é", "a b"]
    shared = [r.choices(vocab, k=r.choice([8, 19, 20, 21, 30, 45])) for _ in range(12)]
    line = [f"l{i}" for i in range(12)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(shared) if r.random() < 0.5 else r.choices(vocab, k=r.randrange(1, 40))
            if r.random() < 0.3:
                w += line
        rows.append((1000 - 7 * i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(2000, rows[3][1]), (2001, rows[3][1].upper()), (2002, "a b " * 200), (1, "a b " * 100), (2003, None), (2004, ""), (2005, " ".join(vocab[:19])), (2006, "same " * 500), (2007, "\x1c".join(vocab[:60]))]
    return rows


def got(df, **more):
    return sorted(map(tuple, substring_dedup.remove_repeats(df, **more).collect()))


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 20, 8, 200), (2, 20, 8, 3), (3, 20, 8, 0), (4, 6, 3, 5), (5, 5, 5, 200)])
def test_kept_words_match_brute_force(spark, monkeypatch, seed, length, gram, hot):
    """Anchors told in shards, by windows, and both."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(5)).withColumn("h", F.lit("x")).withColumn("windows", F.lit(1)).repartition(4)
    want = brute(rows, length)
    assert any(w[2] for w in want)
    assert got(df, length=length, gram=gram) == want


def test_frequent_anchors_and_small_batches(spark, monkeypatch):
    """A passage and a line in most texts; the anchors of the sample's frequent ones never meet in one task."""
    for name, value in (("SAMPLE", 2), ("OFTEN", 3), ("FREQUENT", 20), ("HOT", 4)):
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(1)
    passage, line = " ".join(f"p{i}" for i in range(30)), " ".join(f"l{i}" for i in range(14))
    rows = [(i, " ".join([*r.choices("abcdef", k=9), passage if i % 3 else line, *r.choices("ghijkl", k=9), line])) for i in range(80)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_ids_with_several_texts_null_ids_and_repeated_rows(spark):
    p, q = " ".join(f"w{i}" for i in range(25)), " ".join(f"v{i}" for i in range(25))
    rows = [(None, q), (3, p), (3, f"{p} x"), (3, None), (4, f"y {q}"), (4, f"y {q}"), (2, "short text")]
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"k{i}")):
        df = spark.createDataFrame([(make(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
        out = sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=str)
        texts = [(i, k) for i, _, _, k in out]
        assert texts.count((make(4), "y")) == 2 and (None, q) in texts and (make(3), "") in texts and (make(2), "short text") in texts
        assert {k for i, k in texts if i == make(3)} in ({p, "x", ""}, {"", f"{p} x"})  # of one id's texts, either may be the first
    assert substring_dedup.remove_repeats(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, gram=21)


@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=5), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_automaton_tells_first_ends(texts, length):
    automaton, begin, whole = substring_dedup.SuffixAutomaton(), 0, []
    for t in texts:
        automaton.add(t, begin)
        whole.append((begin, t))
        begin += len(t)
    for t in [*texts, [0, 1, 2, 3, 0, 1], [7]]:
        want = []
        for e in range(len(t)):
            ends = [b + k + length - 1 for b, u in whole for k in range(len(u) - length + 1) if u[k : k + length] == t[e - length + 1 : e + 1]] if e >= length - 1 else []
            want.append(min(ends, default=-1))
        assert automaton.first_ends(t, length) == want


def test_query_matches_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 20)]
        assert sorted(map(tuple, queries.op12_substring_dedup(spark, sf).collect())) == want
