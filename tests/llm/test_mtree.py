import heapq

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotweave.llm import mtree


def brute(rows, asked, k):
    out = []
    for q in asked:
        v = dict(rows)[q]
        if v is None:
            continue
        best = sorted((-int(np.dot(v, x)), i) for i, x in rows if x is not None and i != q and len(x) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_search_matches_scan_and_prunes_clusters(monkeypatch, spread):
    monkeypatch.setattr(mtree, "PAGE", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 100
    x = np.unique(np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 100 * spread).astype(np.int64), axis=0)
    tree = mtree.MTree(x)
    for q in range(0, 60):
        best = []
        tree.search(x[q], 5, lambda i: [i], best)
        want = heapq.nsmallest(5, ((-int(x[q] @ v), i) for i, v in enumerate(x)))
        assert sorted((-s, -i) for s, i in best) == want
    if spread < 1:
        assert tree.computed < 0.6 * tree.scanned


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "POINTS", 100)
    monkeypatch.setattr(mtree, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [int(v) for v in rng.integers(-4, 5, 4)]) for i in range(400)]
    rows += [(400 + i, [1, 2, 3, 4]) for i in range(50)] + [(500, None), (550, [1, 1]), (551, [2, 2]), (552, [3, 1])]
    df = spark.createDataFrame(rows, "id long, vector array<long>").withColumn("score", F.lit(0)).repartition(4)
    asked = [i for i, _ in rows if i % 10 == 0]
    got = sorted(map(tuple, mtree.top_k(df.select("id", "vector"), df.where("id % 10 = 0"), 5).collect()))
    assert got == brute(rows, asked, 5)


def test_scaled_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", mtree.scaled(F.col("e")).alias("vector"))
    assert dict(map(tuple, df.collect())) == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: None}
    assert mtree.top_k(df.limit(0), df.limit(0)).collect() == []
    assert mtree.top_k(df, df).collect() == []


@pytest.mark.parametrize("spread", [1.0, 0.05])
@pytest.mark.parametrize("bounds", [1, 1 << 20])
def test_side_by_side_search_matches_scan_with_copies_ties_and_prunes_clusters(monkeypatch, spread, bounds):
    monkeypatch.setattr(mtree, "PAGE", 20)
    monkeypatch.setattr(mtree, "BOUNDS", bounds)
    rng = np.random.default_rng(3)
    centres = rng.integers(-3, 4, size=(12, 8)) * 100
    x = np.unique(np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 100 * spread).astype(np.int64), axis=0)
    copies = rng.integers(1, 4, len(x))
    first, ids = np.append(0, np.cumsum(copies)), rng.permutation(copies.sum())
    for a, z in zip(first[:-1], first[1:]):
        ids[a:z].sort()
    asked = np.arange(0, len(x), 7)
    tree = mtree.MTree(x)
    place, score, member = tree.search_all(x[asked], ids[first[asked]], 5, first, ids)
    point = np.repeat(np.arange(len(x)), copies)
    for j, a in enumerate(asked):
        want = heapq.nsmallest(5, ((-int(x[a] @ x[p]), int(i)) for p, i in zip(point, ids) if i != ids[first[a]]))
        assert sorted((-int(s), int(i)) for s, i in zip(score[place == j], member[place == j])) == want
    if spread < 1:
        assert tree.computed < 0.6 * tree.scanned


def test_fewer_points_than_asked_for_and_a_lone_one():
    tree = mtree.MTree(np.array([[1, 2], [3, 4]]))
    assert [c.tolist() for c in tree.search_all(np.array([[1, 2], [1, 0]]), np.array([7, 9]), 5, np.array([0, 1, 2]), np.array([7, 8]))] == [[0, 1, 1], [11, 3, 1], [8, 8, 7]]
    tree = mtree.MTree(np.array([[1, 2]]))
    assert not len(tree.search_all(np.array([[1, 2]]), np.array([7]), 5, np.array([0, 1]), np.array([7]))[0])


def test_queries_of_a_block_share_the_visits_to_its_leaves(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-99, 100, size=(4000, 64))
    group = pa.record_batch(
        {
            "part": np.zeros(4300, np.int64),
            "kind": np.repeat(np.array([0, 1], np.int32), [4000, 300]),
            "vector": pa.array([*x.tolist(), *x[:300].tolist()], pa.list_(pa.int64())),
            "ids": pa.array([[i] for i in [*range(4000), *range(300)]], pa.list_(pa.int64())),
        }
    )
    visits, offer = [], mtree.MTree._offer
    monkeypatch.setattr(mtree.MTree, "_offer", lambda self, at, *rest: (visits.append(len(at)), offer(self, at, *rest)))
    (found,) = mtree._search_blocks(iter([group]), 5)
    assert found.num_rows == 1500
    leaves = sum("points" in node for node in mtree.MTree(x).nodes)
    assert leaves <= len(visits) < 10 * leaves  # one by one: 300 visits to nearly every leaf
