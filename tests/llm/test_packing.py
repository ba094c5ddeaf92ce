import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spotweave.llm import packing

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return packing.ByteBpe(*PATHS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), st.sampled_from(" \n\t'sd\x85\xa0\x1c1é")), max_size=40))
def test_ids_are_the_library_s(model, t):
    assert model.encode(t) == model.library.encode(t, add_special_tokens=False).ids


def test_ids_of_odd_texts(model):
    for t in ["", "<|endoftext|>a", "中文 ok", "it's 'sabc  x\n\n y ", "a" * 5000]:
        assert model.encode(t) == model.library.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(0, 9))
def test_evolved_bins_are_legal_and_no_worse_than_best_fit(sizes, seed):
    sizes = np.array(sizes)
    bins, start, made = packing.evolve(sizes, 64, seed)
    assert bins.max() + 1 <= start and (made > 0) == (start > -(-int(sizes.sum()) // 64))
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 64 and fill.min() > 0
    first = packing.insert(np.full(len(sizes), -1), sizes, np.arange(len(sizes)), 64)
    assert len(fill) <= first.max() + 1
    child = packing.crossover(bins, first, sizes, 64, np.random.default_rng(seed))
    assert np.bincount(child, weights=sizes).max() <= 64 and child.min() == 0


def test_packing_is_whole_gapless_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "COLONY", 64)
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "x"], k=int(r.lognormvariate(4, 1.2))))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "word " * 6000), (902, "word " * 6000), (903, "a<|endoftext|>b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)).repartition(3)
    got = packing.pack_documents(df, *PATHS, with_ids=True).collect()
    lib = packing.ByteBpe(*PATHS).library
    want = sorted((i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    docs, bins = {}, {}
    for p in got:
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"] <= 2048
        docs.setdefault(p["doc_id"], []).append(p)
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, ids in want:
        mine = sorted((p for p in docs[i]), key=lambda p: p["piece"])
        if i == 902:
            mine = mine[::2]
        assert [x for p in mine for x in p["ids"]] == ids
        assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine)])[:-1].tolist()
        assert all(p["length"] == 2048 for p in mine[1:])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p["length"] for p in got)
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_crossover_gains_bins_over_its_start_and_over_best_fit():
    gained = 0
    for seed in range(6):
        sizes = np.random.default_rng(seed).integers(16, 40, 60)
        bins, start, made = packing.evolve(sizes, 100, seed, generations=400)
        gained += bins.max() + 1 < packing.insert(np.full(60, -1), sizes, np.arange(60), 100).max() + 1
    assert gained
    sizes = np.random.default_rng(1).integers(400, 1300, 2000)
    bins, start, made = packing.evolve(sizes, 2048, 1, generations=15)  # no newcomer before the eighth
    first, _, _ = packing.evolve(sizes, 2048, 1, generations=0)
    few, _, _ = packing.evolve(sizes, 2048, 1, generations=7)
    assert first.max() + 1 == start and few.max() + 1 < start - 10 and bins.max() <= few.max() and made == 15


def test_the_given_documents_are_packed_by_crossovers(spark, monkeypatch):
    seen = []
    real = packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, name: (seen.append(out) if name == "elites" else None, out)[1] if (out := real(df, name)) is not None else None)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, *PATHS)
    row = got.agg(F.sum("length").alias("total"), F.countDistinct("sequence_id").alias("bins")).first()
    first = seen[0].agg(F.sum("crossovers"), F.sum(F.col("n_start") - F.col("n_bins"))).first()
    assert first[0] > 0 and first[1] > 0
    assert row["bins"] <= 1.005 * row["total"] / 2048 + 1
