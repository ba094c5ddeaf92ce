import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spotweave.llm import queries, spelling


def edit_one(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, least=7, noise=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def brute_variants(n, factor=10):
    near = {w: sorted((v for v in n if edit_one(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] for w, v in near.items() if v and n[v[0]] >= factor * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed, docs=120):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abéÿ", k=r.randrange(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "×÷×÷×÷×", "Éclairée", "éclairée"]
    rows = [(i * 3, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=r.randrange(0, 90)))) for i in range(docs)]
    return [*rows, (5, None), (7, ""), (8, "kurz, and straße_straßenbahn9wörtlich"), (None, "aaaaaaa bbbbbbb bbbbbbb"), (9, vocab[0] * 300 + " x " + vocab[0] * 300), rows[0]]


@pytest.mark.parametrize("seed,limit", [(1, 16384), (2, 9), (3, 2)])
def test_variants_match_brute_force(spark, monkeypatch, seed, limit):
    """Groups as they are, and dealt in blocks."""
    real = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: real(words, limit))
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(2)).repartition(3)
    want = brute_variants({w: n for w, n in brute_counts(rows).items() if n >= 2})
    assert sum(w[1] is not None for w in want) > 5
    assert sorted(map(tuple, spelling.spelling_variants(df).collect()), key=lambda x: x[0]) == want


def test_chains_of_forms_end_at_the_last(spark):
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(w, 3 * 10**i) for i, w in enumerate(words)] + [("zzzzzzz", 5)]
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()))
    assert got == brute_variants(dict(rows)) and {r[2] for r in got} == {"aabbbbb", "zzzzzzz"}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, "word string, n long"), 1)


def test_shared_indexes_across_small_batches(spark, monkeypatch):
    """Groups that reach over batches, and indexes that hold many groups or one."""
    r = random.Random(4)
    n = {w: r.randrange(2, 400) for w in {"".join(r.choices("abc", k=r.randrange(3, 8))) for _ in range(900)}}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = [(w, k, c, b) for w, k, c, b in ((w, len(v), n[v[0]], v[0]) for w, v in ((w, sorted((v for v in n if edit_one(w, v)), key=lambda v: (-n[v], v))) for w in n) if v)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        for limit in (16384, 40):
            assert sorted(map(tuple, spelling.near_words(df, limit).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_counts_of_many_words_and_no_rows(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for noise in (31, 2, 0):
        assert dict(map(tuple, spelling.word_counts(df, noise=noise).collect())) == brute_counts(rows, noise=noise)
    assert spelling.spelling_variants(df.where("false")).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = {w: k for w, k in brute_counts(rows).items() if k >= 2}
    got = sorted(map(tuple, queries.op13_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    keep = sorted(n)[::7]  # the comparison's words; each against all
    near = {w: sorted((v for v in n if abs(len(v) - len(w)) < 2 and edit_one(w, v)), key=lambda v: (-n[v], v)) for w in keep}
    assert [(w, r[4], r[5]) for r in got if (w := r[0]) in near] == [(w, len(near[w]), n[near[w][0]] if near[w] and n[near[w][0]] >= 10 * n[w] else None) for w in keep]
    assert [r[0] for r in got] == sorted(n)
