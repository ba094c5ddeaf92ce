"""Sums, edges and counts by tile against joins and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import circles, kernels
from spotweave.operators import detect, predict, spatial
from spotweave.plans import more_queries  # noqa: F401
from spotweave.plans import queries

SF = "/root/testdata/sf0.001"


def cells(spark, n=300, copies=3, seed=1):
    """Cells of two types about several tiles, some at one place, one without a type and one without a place."""
    rng = np.random.default_rng(seed)
    at = [(float(rng.integers(-300, 300)) / 10, float(rng.integers(-20, 20)), "ab"[int(rng.integers(2))]) for _ in range(n // copies)]
    rows = [(i, *at[i % len(at)]) for i in range(n)] + [(n, 0.0, 0.0, None), (n + 1, None, 0.0, "a"), (n + 2, 500.0, 500.0, "a")]
    return spark.createDataFrame(rows, "cell_id long, x double, y double, cell_type string")


def test_edges_are_found_without_a_shuffle_of_edges(spark):
    """Only the cells are dealt out; edges that are shuffled take the disk of the result several times over."""
    plan = queries.QUERIES["neighbor_graph"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("pairs", [40, 250_000])
def test_edges_and_weights_match_brute_force(spark, pairs):
    rng = np.random.default_rng(2)
    x, y = np.repeat(rng.integers(0, 200, 40) / 10, 3), np.repeat(rng.integers(0, 20, 40), 3).astype(float)
    home, radius = rng.random(120) < 0.6, 4.0
    was, circles.PAIRS = circles.PAIRS, pairs
    try:
        got = {(a, b): w for s, d, v in circles.weighted_edges(x, y, home, radius) for a, b, w in zip(s.tolist(), d.tolist(), v.tolist())}
    finally:
        circles.PAIRS = was
    far = np.hypot(x[:, None] - x, y[:, None] - y)
    w = np.where((far <= radius) & ~np.eye(120, dtype=bool), 1 / (far + 1e-6), 0)
    w += np.diag(np.where((w > 0).any(1), w.sum(1) / np.maximum((w > 0).sum(1), 1), 1))
    w /= w.sum(1, keepdims=True)
    assert sorted(got) == [tuple(map(int, p)) for p in np.argwhere(w > 0) if home[p[0]]]
    assert all(abs(v - w[p]) < 1e-9 for p, v in got.items())


def wide(spark, df):
    return df.select("cell_id", "cell_type", "x", "y", (F.col("cell_id") % 3 == 0).alias("labeled"), F.array((F.col("cell_id") % 7).cast("double"), F.lit(2.5)).alias("v"))


def long(values):
    return {(r[0], r[1]): r[2] for r in values.select("cell_id", F.posexplode("v").alias("gene", "value")).collect()}


def test_a_step_by_tiles_is_that_on_the_graph(spark):
    df = cells(spark)
    start = wide(spark, df)
    rows = start.select("cell_id", "labeled", F.posexplode("v").alias("gene", "value"))
    want = {(r.cell_id, r.gene): r.value for r in predict.diffusion_step(rows, predict.radius_graph(df, 6.0)).collect()}
    got = long(predict.near_step(start, 6.0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_diffusion_by_tiles_ends_where_that_on_the_graph_does(spark):
    df = cells(spark, 90, 2, 4)
    start = wide(spark, df)
    rows = start.select("cell_id", "labeled", F.posexplode("v").alias("gene", "value"))
    want = {(r.cell_id, r.gene): r.value for r in predict.diffuse(rows, predict.radius_graph(df, 6.0), tol=0.01, patience=2).collect()}
    got = long(predict.diffuse_near(start, 6.0, tol=0.01, patience=2))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("pair_s", [6e-9, 1.0])
def test_counts_by_pairs_and_by_rows_match_brute_force(monkeypatch, pair_s):
    """Places on a grid, so that many distances are the radius itself; squares are compared, as in SQL."""
    monkeypatch.setattr(circles, "PAIR_S", pair_s)
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y, kind = rng.integers(0, 3000, 400) / 100, rng.integers(0, 30, 400).astype(float), rng.integers(0, 4, 400)
        x[:200] = np.floor(x[:200]) + 0.1
        home = rng.random(400) < 0.7
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 25
        want = np.stack([(near & (kind == k)).sum(1) for k in range(3)], 1)[home]
        assert (circles.kind_counts(x, y, kind, 3, home, 5.0) == want).all()


@pytest.mark.parametrize("alone", [False, True])
def test_wide_counts_are_the_long_ones(spark, alone):
    df = cells(spark)
    long_rows = {(r.cell_id, r.cell_type): r.n for r in spatial.neighborhood_composition(df, 5.0, None, alone).collect()}
    got = {r.cell_id: (r.n_a, r.n_b) for r in spatial.neighborhood_composition(df, 5.0, ["a", "b"], alone).collect()}
    assert got == {i: (long_rows.get((i, "a"), 0), long_rows.get((i, "b"), 0)) for i in {k[0] for k in long_rows}}


def test_counts_wanted_of_one_type(spark):
    df = cells(spark)
    every = {r.cell_id: r.n_b for r in spatial.neighborhood_composition(df, 5.0, ["b"]).collect()}
    kind = {r.cell_id: r.cell_type for r in df.collect()}
    got = {r.cell_id: r.n_b for r in spatial.neighborhood_composition(df, 5.0, ["b"], only="a").collect()}
    assert got == {i: n for i, n in every.items() if kind[i] == "a"}


def test_counts_make_no_pairs(spark):
    """A join of the pairs grows with the square of the density."""
    plan = queries.QUERIES["neighborhood_composition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_removal_of_overlaps_by_tiles_writes_no_pairs_and_is_greedy(spark, monkeypatch):
    """About 200 tiles; equal boxes, chains across tiles, a box without an area and one without an end."""
    rng = np.random.default_rng(9)
    rows = [(i, int(r), int(c), int(r + h), int(c + w)) for i, (r, c, h, w) in enumerate(zip(rng.integers(0, 500, 1500), rng.integers(0, 500, 1500), rng.integers(3, 7, 1500), rng.integers(2, 5, 1500)))]
    rows += [(2000 + i, 5 * i, 250, 5 * i + 6, 254) for i in range(90)] + [(3000 + i, *rows[i][1:]) for i in range(300)]
    monkeypatch.setattr(detect, "overlap_pairs", None)
    odd = [(9000, 10, 10, 10, 20), (9001, 10, 10, None, 20)]
    frame = spark.createDataFrame(rows + odd, "cell_id long, rmin long, cmin long, rmax long, cmax long")
    got = sorted(r[0] for r in detect.overlap_dedup(frame, cell=16.0).select("cell_id").collect())
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    common = lambda a, b: max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
    kept = []
    for b in sorted(rows, key=lambda b: (-area(b), b[0])):
        if not any(common(a, b) > 0.01 * min(area(a), area(b)) for a in kept):
            kept.append(b)
    assert got == sorted(b[0] for b in kept + odd)


def test_common_areas_at_once_are_those_one_by_one():
    """A loop of pairs took 30 times as long."""
    rng = np.random.default_rng(11)
    for ka, kb in ((4, 4), (3, 5)):
        turn = [np.sort(rng.random((300, k)) * 2 * np.pi, 1) for k in (ka, kb)]
        (ax, ay), (bx, by) = (((1 + rng.random(t.shape) * 3) * np.cos(t) + rng.random((300, 1)) * 4, (1 + rng.random(t.shape) * 3) * np.sin(t)) for t in turn)
        want = [kernels.common_area(*p) for p in zip(ax, ay, bx, by)]
        assert np.abs(kernels.common_areas(ax, ay, bx, by) - want).max() < 1e-12
