import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spotweave.llm import language_model as lm


def tokens_of(t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def corpus():
    r = random.Random(4)
    chain = {w: [f"w{(i * 7 + k) % 50}" for k in range(3)] for i, w in enumerate(f"w{i}" for i in range(50))}
    rows = []
    for i in range(300):
        w = [f"W{r.randrange(50)}"]
        for _ in range(r.randrange(0, 40)):
            w.append(r.choice(chain[f"w{int(w[-1][1:]) % 50}"]) if r.random() < 0.9 else f"w{r.randrange(80)}")
        rows.append((i, " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "never seen élan")]


@pytest.mark.parametrize("order", [2, 3])
def test_counts_and_base_match_brute_force_and_model_beats_base(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm.T, "SLICE_BYTES", 700)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fold", F.lit("x")).repartition(3)
    got = {r["doc_id"]: r for r in lm.score_documents(df, order).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens_of(x))
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for i, x in rows:
        t = tokens_of(x)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        gain += (r["score"] - r["base_score"]) * held[i]
    assert gain > 0


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    # Three known words after a context seen four times, and the unknown word.
    p, context = lm.estimates([np.array([4.0, 5, 3, 2]), np.array([1.0, 1, 3, 0])], 4.0, 14.0, 3.0)
    assert p[0].sum() == pytest.approx(4 / 4) and p[1].sum() == pytest.approx(1)
    assert context[0] == 4


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_any_type(spark):
    rows = [(f"k\n{i}" if i else None, f"some words of text {i % 5}") for i in range(40)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    assert got.keys() == {i for i, _ in rows} and all(r["held_out"] == (zlib.crc32((i or "").encode()) % 7 == 2) for i, r in got.items())
