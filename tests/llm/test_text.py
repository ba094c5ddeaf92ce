import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotweave.llm import jaccard, language_model, suffix_dedup, text as T, toxicity

#: Longer than a slice, and than any power table made before.
LONG = "long tale of many words " * 140_000


def hashes(t):
    (_, _, data, offsets), = T.text_slices(pa.array([t]))
    starts, ends, _ = T.words(data, offsets)
    return [T.word_hashes(data, starts, ends), *T.word_and_prefix_hashes(data, starts, ends, (2, 4)), T.second_span_hashes(T.word_hashes(data, starts, ends), np.zeros(1, int), np.array([len(starts)]))]


def test_hashes_do_not_depend_on_what_was_hashed_before():
    before = hashes("Hello world, hello again")
    assert len(LONG) > 3_000_000
    hashes(LONG)
    assert all(np.array_equal(a, b) for a, b in zip(before, hashes("Hello world, hello again")))


def test_equal_spans_have_equal_hashes_wherever_they_are():
    h = T.mix64(np.arange(40, dtype=np.uint64) % 8)
    for f in (T.span_hashes, T.second_span_hashes):
        got = f(h, np.array([0, 8, 16, 1, 0]), np.array([8, 16, 24, 9, 7]))
        assert got[0] == got[1] == got[2] and len(set(got.tolist())) == 3


def test_long_values_are_hashed_in_pieces(monkeypatch):
    data = np.frombuffer(("Some words, " * 300).encode(), np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    h = T.mix64(np.arange(500, dtype=np.uint64) % 7)
    at = np.arange(460)
    want = [T.word_hashes(data, starts, ends), *T.word_and_prefix_hashes(data, starts, ends, (2, 4)), T.span_hashes(h, at, at + 40), T.second_span_hashes(h, at, at + 40)]
    for size in (50, 7, 1):
        monkeypatch.setattr(T, "SLICE_BYTES", size)
        T._powers.clear()
        got = [T.word_hashes(data, starts, ends), *T.word_and_prefix_hashes(data, starts, ends, (2, 4)), T.span_hashes(h, at, at + 40), T.second_span_hashes(h, at, at + 40)]
        assert all(np.array_equal(a, b) for a, b in zip(want, got)) and max(map(len, T._powers.values())) <= 60
    T._powers.clear()


def orders(rows):
    """The rows with the long text first, in the middle and last."""
    return [rows[:k] + [(99, LONG)] + rows[k:] for k in (0, len(rows) // 2, len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_jaccard_with_a_long_text_anywhere(spark):
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, w), (2, w + " extra"), (3, w), (4, "other words here now")]
    for each in orders(rows):
        got = {r[0]: r[2] for r in jaccard.jaccard_components(frame(spark, each)).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 99: 99}


def test_suffix_dedup_with_a_long_text_anywhere(spark):
    p = " ".join(f"w{i}" for i in range(60))
    for each in orders([(1, "a " + p), (2, "quite another text"), (3, f"b {p} c")]):
        got = [tuple(r) for r in suffix_dedup.repeated_spans(frame(spark, each)).collect()]
        assert got == [(3, 1, 60, 1)]


def test_language_model_with_a_long_text_anywhere(spark):
    rows = [(i, f"some words of text {i % 3}") for i in range(12)]
    seen = []
    for each in orders(rows):
        got = {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in language_model.score_documents(frame(spark, each)).collect()}
        assert len(got) == 13
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("at", [0, 1, 2])
def test_toxicity_with_a_long_text_anywhere(spark, at):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(300):
        w = r.choices(words, k=60)
        for _ in range(6 * (i % 4 == 0)):
            w.insert(r.randrange(len(w)), r.choice(["vile", "rotten", "grubby"]))
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, 1, int(i % 4 == 0)))
    each = orders(docs)[at]
    df = frame(spark, each)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"] for x in toxicity.score_texts(df, model).where(F.col("predicted") == 1).collect()}
    want = {i for i, _, t in labels if t}
    assert len(got ^ want) <= 4
