import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.llm import jaccard


def brute(rows, n, num, den):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, count, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(count):
        if rows and r.random() < 0.6:
            w = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.2:
                w += r.choices(words, k=3)
        else:
            w = r.choices(words, k=r.choice([0, 1, 3, 4, 5, 12, 40, 120, 300]))
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,n,num,den,limits", [(1, 4, 85, 100, None), (2, 5, 80, 100, None), (3, 4, 85, 100, (5, 4))])
def test_components_match_brute_force(spark, monkeypatch, seed, n, num, den, limits):
    if limits:  # every group and neighbourhood is dealt out
        monkeypatch.setattr(jaccard, "GROUP", limits[0])
        monkeypatch.setattr(jaccard, "NEIGHBOURHOOD", limits[1])
    rows = corpus(seed, 160) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_shingles", F.lit("x")).repartition(5)
    got = sorted(map(tuple, jaccard.jaccard_components(df, n, num, den).collect()))
    assert got == brute(rows, n, num, den)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).collect() == []
    assert jaccard.jaccard_components(df).columns == ["doc_id", "n_shingles", "component_id"]


def test_key_ignores_order_of_rows():
    a = np.array([1, 2, 3], np.uint64)
    assert jaccard.set_key(a) == jaccard.set_key(a[::-1]) != jaccard.set_key(a[:2])


def test_ids_with_several_texts_null_ids_and_string_ids(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "other words stand here under one id"), (1, w), (2, w + " extra"), (3, w), (3, w), (None, w), (None, "lonely words without any id")]
    for kind, make in (("long", lambda i: i), ("string", lambda i: None if i is None else f"k{i}")):
        df = spark.createDataFrame([(make(i), t, 1) for i, t in rows], f"doc_id {kind}, text string, __id0 int").repartition(3)
        got = sorted(((r[0], r[2]) for r in jaccard.jaccard_components(df).collect()), key=str)
        assert got == sorted([(make(1), make(1))] * 2 + [(make(2), make(1)), (make(3), make(1)), (make(3), make(1)), (None, make(1)), (None, None)], key=str)
        kept = jaccard.one_per_component(df)
        assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(make(1), rows[0][1]), (make(1), w), (None, rows[6][1])], key=str)
        assert kept.columns == df.columns


def test_hot_classes_are_joined_without_a_shuffle_of_their_rows(spark):
    rows = [(i, "the same few words again" if i % 3 else f"own words of number {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard.jaccard_components(df)
    assert all(r[2] == (1 if r[0] % 3 else r[0]) for r in out.collect())
