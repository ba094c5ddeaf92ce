import random

import pytest
from pyspark.sql import functions as F

from spotweave.llm import suffix_dedup


def brute(rows, length):
    words = {i: (t or "").lower().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = []
    for i, w in words.items():
        mark = [first[tuple(w[k : k + length])] < i for k in range(len(w) - length + 1)]
        span = None
        for k, m in enumerate(mark):
            if m:
                if span and k <= span[1]:
                    span[1] = k + length
                else:
                    if span:
                        out.append((i, span[0], span[1] - span[0]))
                    span = [k, k + length]
        if span:
            out.append((i, span[0], span[1] - span[0]))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [r.choices(vocab, k=r.choice([20, 49, 50, 51, 80, 200])) for _ in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(r.randrange(0, 5)):
            w += r.choice(shared) if r.random() < 0.5 else r.choices(vocab, k=r.randrange(1, 60))
        rows.append((1000 - 7 * i, " ".join(w)))
    rows += [(2000, rows[3][1]), (2001, rows[3][1].upper()), (2002, "a b " * 200), (1, "a b " * 100), (2003, None), (2004, ""), (2005, " ".join(vocab[:49]))]
    return rows


@pytest.mark.parametrize("seed,length,gram", [(1, 50, 25), (2, 50, 25), (3, 12, 6)])
def test_spans_match_brute_force(spark, seed, length, gram):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(5)).repartition(4)
    got = suffix_dedup.repeated_spans(df, length, gram).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == brute(rows, length)
    assert all(r[3] < r[0] for r in got)


def test_cut_texts_have_no_repeats_left_and_firsts_stay(spark):
    a, b = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(70))
    rows = [(1, f"q {a} r", "k"), (2, f"s\n{a} t {b}", "k"), (3, f"{b}", "k"), (4, None, "k"), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k string")
    got = {r[0]: (r[1], r[2]) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == {1: (f"q {a} r", "k"), 2: (f"s\nt {b}", "k"), 4: (None, "k"), 5: ("", None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(df).collect() == []
    assert suffix_dedup.without_repeats(df).collect() == []


def brute_within(rows, length):
    """Per text the places of words that a repeat, in order of id and start, adds after its first occurrence."""
    first, cut = {}, {}
    for i, t in sorted(rows):
        w = (t or "").lower().split()
        for k in range(len(w) - length + 1):
            j, s = first.setdefault(tuple(w[k : k + length]), (i, k))
            if (j, s) != (i, k):
                cut.setdefault(i, set()).update(range(max(k, s + length) if i == j else k, k + length))
    return cut


@pytest.mark.parametrize("seed,length,gram", [(1, 50, 25), (3, 12, 6)])
def test_repeats_within_a_document_match_brute_force(spark, seed, length, gram):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = [x for x in corpus(seed) if x[0] not in (2000, 2001)] + [(3000, " ".join(sum(([*passage, f"s{i}"] for i in range(40)), []))), (3001, " ".join(r.choices("xy", k=300)))]
    rows = [(i, t) for n, (i, t) in enumerate(rows) if not t or t not in [u for _, u in rows[:n]]]
    got = {}
    for i, start, n, source in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, gram, within=True).collect():
        got.setdefault(i, set()).update(range(start, start + n))
        assert source <= i
    assert got == brute_within(rows, length) and 3000 in got


def test_cut_texts_keep_one_copy_of_a_passage_within_a_document(spark):
    p = " ".join(f"x{i}" for i in range(60))
    rows = [(1, " ".join([p] * 1000)), (2, f"{p} z {p}"), (3, "a b " * 200)]
    got = dict(suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[1].split() == p.split() and got[2].split() == ["z"] and got[3].split() == ["a", "b"] * 25


def test_ids_with_several_texts_null_texts_and_any_type(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p), (3, None), (3, f"a {p}"), (3, "a short other text"), (4, p), (4, p), (None, p), (None, None)]
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"k{i}")):
        df = spark.createDataFrame([(make(i), t, 0, "x", "y") for i, t in rows], f"doc_id {kind}, text string, __cuts0 int, id string, `th.x` string").repartition(3)
        spans = sorted(map(tuple, suffix_dedup.repeated_spans(df).collect()))
        assert spans == [(make(3), 1, 60, make(1)), (make(4), 0, 60, make(1))]
        out = suffix_dedup.without_repeats(df)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert got == sorted([(make(1), p), (make(3), None), (make(3), "a "), (make(3), "a short other text"), (None, p), (None, None)], key=lambda x: str((x[0], x[1])))
        assert out.columns == df.columns


@pytest.mark.parametrize("rows_per_part", [7, 1])
def test_runs_that_reach_over_range_ends(spark, monkeypatch, rows_per_part):
    """Hot passages over many small ranges, so runs go on through whole partitions."""
    real = suffix_dedup.in_order
    monkeypatch.setattr(suffix_dedup, "in_order", lambda df, run, schema, count: real(df, run, schema, count, max(rows_per_part, count // 60)))
    p = " ".join(f"w{i}" for i in range(14))
    rows = [(i, f"a{i} {p} b{i} " + (p if i % 3 == 0 else "")) for i in range(40)]
    for within in (False, True):
        got = {}
        for i, start, n, source in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 12, 6, within=within).collect():
            got.setdefault(i, set()).update(range(start, start + n))
        want = {i: {k for _, a, n in [x for x in brute(rows, 12) if x[0] == i] for k in range(a, a + n)} for i in {x[0] for x in brute(rows, 12)}} if not within else brute_within(rows, 12)
        assert got == want
