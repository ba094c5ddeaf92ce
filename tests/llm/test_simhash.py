import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spotweave.llm import simhash


def corpus():
    r = random.Random(5)
    words = [f"wörd{i}" for i in range(500)]
    rows = [(i * 5 - 40, " ".join(r.choices(words, k=r.randrange(30, 200)))) for i in range(300)]
    return [*rows, (10_001, None), (10_002, ""), (10_003, "a"), (10_004, "  lead\ttrail \n"), (10_004, "  lead\ttrail \n"), (10_005, "𝒳yz" * 3), (99_999, rows[0][1])]


def test_edited_texts_and_likeness(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x")).repartition(5)
    got = sorted(simhash.compare_edited(df).collect(), key=lambda x: (x["doc_id"], x["n_chars"]))
    rows = sorted((i, t or "") for i, t in rows)
    assert [g["doc_id"] for g in got] == [i for i, _ in rows]
    for k, (g, (i, t)) in enumerate(zip(got, rows)):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        d = bin(int(g["fingerprint"], 16) ^ int(g["edited_fingerprint"], 16)).count("1")
        assert g["near_edited"] == 1 - d / 128
        d = bin(int(g["fingerprint"], 16) ^ int(got[(k + 1) % len(got)]["fingerprint"], 16)).count("1")
        assert g["near_next"] == 1 - d / 128
    by = {g["doc_id"]: g["fingerprint"] for g in got}
    assert by[99_999] == by[-40]
    long = [g for g in got if g["n_chars"] > 200]
    assert sum(g["near_edited"] > g["near_next"] for g in long) >= 0.97 * len(long)


def test_near_fingerprints_match_brute_force(spark):
    r = random.Random(8)
    values = [r.getrandbits(128) for _ in range(40)]
    for v in values[:30]:
        for _ in range(2):
            x = v
            for b in r.sample(range(128), r.randrange(0, 6)):
                x ^= 1 << b
            values.append(x)
    rows = [(f"{v:032x}",) for v in values] + [(None,), (f"{values[0]:032x}",)]
    df = spark.createDataFrame(rows, "fingerprint string")
    got = sorted(map(tuple, simhash.near_fingerprints(df, df, 3).collect()))
    want = sorted((f"{a:032x}", f"{b:032x}", d) for a in set(values) for b in set(values) if a != b and (d := (a ^ b).bit_count()) <= 3)
    assert got == want and want


def test_a_key_of_many_fingerprints_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 5)
    values = [(7 << 100) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    df = spark.createDataFrame([(f"{v:032x}",) for v in values] * 2, "fingerprint string")
    got = dict(map(tuple, simhash.near_counts(df.limit(40), df, 3).collect()))
    every = set(values)
    assert got == {k: sum(v != int(k, 16) and (v ^ int(k, 16)).bit_count() <= 3 for v in every) for k in got} and max(got.values()) > 5


def edited_of(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: x[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("make", [lambda i: (i - 200) * 46_000_000_000_000_000, lambda i: i if i < 399 else 10**15, lambda i: f"document-{i:06d}", lambda i: "z" * (i % 7) + str(i)])
def test_any_ids(spark, monkeypatch, make):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rows = [(make(i), f"text number {i} of some words {i * 7}") for i in range(400)]
    df = spark.createDataFrame(rows, f"doc_id {'string' if isinstance(make(0), str) else 'long'}, text string").repartition(3)
    got = simhash.compare_edited(df).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == edited_of(rows) and len(got) == 400
    sizes = [r["count"] for r in simhash._buckets(df.select(F.col("doc_id").alias("id"), "text")).groupBy("bucket").count().collect()]
    assert max(sizes) <= 100


def test_an_id_that_repeats_is_cut_by_its_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rows = [(i if i % 3 else 7, f"text number {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string")
    sizes = [r["count"] for r in simhash._buckets(df).groupBy("bucket").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 100
    got = simhash.compare_edited(df, "id").collect()
    asked = [r for r in got if r["n_near"] is not None]
    assert len(got) == 1500 and all(r["id"] % 20 == 0 for r in asked) and len(asked) == sum(i % 20 == 0 for i, _ in rows)


def test_fingerprints_are_a_function_of_the_text(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, None), (5, " ")], "doc_id long, text string")
    got = dict(map(tuple, simhash.fingerprints(df).collect()))
    assert got[1] == got[2] != got[3] and got[4] == got[5] and len(got) == 5
    assert simhash.fingerprints(df.limit(0)).collect() == []
    assert simhash.compare_edited(df.limit(0)).collect() == []
