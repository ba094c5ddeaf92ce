"""Hand-computed micro-fixtures and properties of the engine's operators."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spotweave.functions import kernels
from spotweave.operators import annotate, assign, deconv, detect, ensemble, matrix, predict, spatial, stats
from spotweave.plans import model_queries, more_queries, queries, roles
from spotweave.sources import io

SF = "/root/testdata/sf0.001"


def points(spark, rows, id_col):
    return spark.createDataFrame(rows, f"{id_col} long, x double, y double")


def test_radius_join_scalar_and_per_query(spark):
    base = points(spark, [(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 2.0), (3, None, 1.0)], "base_id")
    query = points(spark, [(0, 0.1, 0.1), (1, 1.8, 1.9)], "query_id")
    got = lambda df: sorted((r[0], r[1]) for r in df.collect())
    assert got(spatial.radius_join(query, base, 0.5)) == [(0, 0), (1, 2)]
    each = query.withColumn("reach", F.when(F.col("query_id") == 0, 0.5).otherwise(0.2))
    assert got(spatial.radius_join(each, base, "reach")) == [(0, 0)]
    corner = points(spark, [(0, 1.0, 1.0)], "base_id")
    origin = points(spark, [(0, 0.0, 0.0)], "query_id")
    assert got(spatial.radius_join(origin, corner, 1.0, "chebyshev")) == [(0, 0)]
    assert got(spatial.radius_join(origin, corner, 1.0)) == []
    with pytest.raises(ValueError):
        spatial.radius_join(origin, corner, 1.0, "manhattan")


def test_neighbourhood_counts_the_cell_itself(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0, "A"), (1, 1.0, 0.0, "B"), (2, 5.0, 0.0, "A")], "cell_id long, x double, y double, cell_type string")
    got = sorted(map(tuple, spatial.neighborhood_composition(cells, 1.0, ["A", "B"]).collect()))
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 0)]


def test_tiles(spark):
    got = spatial.tile_grid(spark.createDataFrame([("i", 300, 300)], "image_id string, width long, height long")).collect()
    assert sorted((r["y0"], r["x0"]) for r in got) == [(0, 0), (0, 192), (192, 0), (192, 192)]


def test_largest_remainder(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, 7), (1, "b", 0.3, 7), (1, "c", 0.2, 7), (2, "a", 0.0, 4), (2, "b", 0.0, 4)], "g int, cell_type string, value double, total long")
    got = {(r["g"], r["cell_type"]): r["quota"] for r in annotate.largest_remainder(rows, ["g"]).collect()}
    assert got == {(1, "a"): 4, (1, "b"): 2, (1, "c"): 1, (2, "a"): 2, (2, "b"): 2}


def test_row_normalize_and_weighted_median(spark):
    rows = spark.createDataFrame([(1, -1.0), (1, 2.0), (1, 2.0)], "obs int, value double")
    assert sorted(r["value"] for r in matrix.row_normalize(rows).collect()) == [0.0, 0.5, 0.5]
    rows = spark.createDataFrame([(1, 1.0, 0.2), (1, 2.0, 0.3), (1, 9.0, 0.5)], "g int, value double, weight double")
    assert ensemble.weighted_median(rows, ["g"]).first()["value"] == 2.0


def test_benjamini_hochberg_and_hypergeometric(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = {r["id"]: r["p_adjust"] for r in stats.benjamini_hochberg(rows).collect()}
    assert got[4] is None and [round(got[i], 6) for i in (1, 2, 3)] == [0.03, 0.04, 0.04]
    row = spark.createDataFrame([(9, 200, 40, 30)], "x int, n int, k int, m int")
    assert row.select(stats.hypergeometric_tail("x", "n", "k", "m")).first()[0] == pytest.approx(0.110378866)


def test_t_tail_by_incomplete_beta():
    # P(|t| > 2) with 10 degrees of freedom.
    assert stats.beta_inc(5, 0.5, 10 / 14) == pytest.approx(0.0733880, abs=1e-6)


def test_endecon_of_equal_inputs_is_the_input(spark):
    rows = [(s, m, t, v) for s in (1, 2) for m in ("a", "b") for t, v in (("x", 1.0), ("y", 3.0))]
    out, weights = ensemble.endecon(spark.createDataFrame(rows, "spot_id int, method string, cell_type string, value double"), ["a", "b"])
    assert {(r["spot_id"], r["cell_type"]): r["value"] for r in out.collect()} == {(s, t): v for s in (1, 2) for t, v in (("x", 0.25), ("y", 0.75))}
    assert weights == {"a": 0.5, "b": 0.5}


def test_endecon_query_ends_where_the_loop_does(spark):
    m = roles.method_proportions(spark, SF).toPandas()
    v = m.pivot_table(index=["spot_id", "cell_type"], columns="method", values="value", fill_value=0.0)[more_queries.METHODS].to_numpy()
    keys = list(m.pivot_table(index=["spot_id", "cell_type"], columns="method", values="value").index)
    h, before, scale, rounds = v.mean(1), 0.0, None, 0
    for rounds in range(1, 101):
        l1 = np.abs(v - h[:, None]).sum(0)
        scale = np.quantile(l1, 0.5) if scale is None else scale
        w = np.exp(-(l1 - l1.min()) / scale)
        w /= w.sum()
        order = np.argsort(v, 1, kind="stable")
        h = np.array([r[o][np.searchsorted(np.cumsum(w[o]), 0.5)] for r, o in zip(v, order)])
        loss = (l1 * w).sum() + scale * (w * np.log(w + 1e-12)).sum()
        if abs(loss - before) < 1e-5:
            break
        before = loss
    total = {}
    for (s, _), x in zip(keys, h):
        total[s] = total.get(s, 0.0) + x
    want = {k: x / total[k[0]] for k, x in zip(keys, h)}
    got = {(r["spot_id"], r["cell_type"]): r["value"] for r in queries.QUERIES["endecon_consensus"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-6
    assert "endecon_consensus" not in queries.SQL and rounds < 100


@pytest.mark.parametrize("n,gamma", [(3, 0.1), (12, 0.1), (40, 0.1), (40, 2.0)])
def test_diffusion_ends_where_the_loop_does(spark, n, gamma):
    # A chain whose first cell is labelled.
    w = np.zeros((n, n))
    for i in range(n):
        w[i, max(i - 1, 0) : i + 2] = 1.0
    w /= w.sum(1, keepdims=True)
    v, labeled, best, wait = np.where(np.arange(n) == 0, 50.0, 0.0), np.arange(n) == 0, np.inf, 0
    for _ in range(20):
        keep = 1 / (1 + gamma)
        new = np.where(labeled, keep * v + (1 - keep) * (w @ v), w @ v)
        diff = ((new - v)[~labeled] ** 2).mean()
        best, wait = (diff, 0) if diff < best - 1e-4 else (best, wait + 1)
        if wait >= 5:
            break
        v = new
    values = spark.createDataFrame([(i, "g", i == 0, 50.0 if i == 0 else 0.0) for i in range(n)], "cell_id long, gene string, labeled boolean, value double")
    graph = spark.createDataFrame([(i, j, float(w[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(w)))], "src long, dst long, w double")
    got = {r["cell_id"]: r["value"] for r in predict.diffuse(values, graph, gamma).collect()}
    assert np.allclose([got[i] for i in range(n)], v, atol=1e-9) and got[2] > 0
    assert "label_diffusion_full" in queries.QUERIES and "label_diffusion_full" not in queries.SQL


def test_split_expression(spark):
    props = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "spot_id int, cell_type string, value double")
    means = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0)], "cell_type string, gene int, mean double")
    counts = spark.createDataFrame([(1, 1, 8.0)], "spot_id int, gene int, value double")
    got = {r["cell_type"]: r["value"] for r in predict.split_expression(props, means, counts, normalize=False).collect()}
    assert got == {"a": 2.0, "b": 6.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 6), st.integers(2, 3))
def test_assignment_is_optimal(seed, n, k):
    rng = np.random.default_rng(seed)
    score = rng.random((n, k)).round(2)
    quota = np.bincount(rng.integers(0, k, n), minlength=k)
    got = kernels.assign_with_quota(score, quota)
    assert (np.bincount(got, minlength=k) == quota).all()
    best = max(score[range(n), list(p)].sum() for p in itertools.product(range(k), repeat=n) if (np.bincount(p, minlength=k) == quota).all())
    assert score[range(n), got].sum() == pytest.approx(best)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 4)), rng.normal(size=12)
    x = kernels.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g >= -1e-7).all() and abs(g @ x) < 1e-6


def test_delaunay_has_empty_circles():
    rng = np.random.default_rng(3)
    p = rng.random((60, 2))
    e = {tuple(x) for x in kernels.delaunay_edges(p[:, 0], p[:, 1])}
    want = set()
    for i, j, k in itertools.combinations(range(60), 3):
        m = np.array([p[j] - p[i], p[k] - p[i]])
        c = np.linalg.solve(2 * m, (m * m).sum(1)) + p[i]
        if (np.hypot(*(p - c).T) >= np.hypot(*(p[i] - c)) - 1e-12).all():
            want |= {(i, j), (i, k), (j, k)}
    assert e == want


@pytest.mark.parametrize("tile_cells,last_cells", [(2000, 10_000), (40, 30)])
def test_tiled_delaunay_graph_is_that_of_one_triangulation(spark, monkeypatch, tile_cells, last_cells):
    monkeypatch.setattr(predict, "TILE_CELLS", tile_cells)
    monkeypatch.setattr(predict, "LAST_CELLS", last_cells)
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.exponential(60, (300, 2)), rng.uniform(0, 900, (60, 2)), rng.normal(300, 5, (150, 2))])
    kind = np.where(np.arange(len(xy)) % 3 == 0, "a", "b")
    rows = [(i, float(x), float(y), str(t)) for i, ((x, y), t) in enumerate(zip(xy, kind))] + [(1000, 5.0, 5.0, None), (1001, 7.0, 5.0, None), (1002, 1.0, 1.0, "c")]
    cells = spark.createDataFrame(rows, "cell_id long, x double, y double, cell_type string")
    got = {(r["src"], r["dst"]) for r in predict.delaunay_graph(cells, 120.0, 60.0).collect()}
    want = {(1000, 1001), (1001, 1000)} | {(i, i) for i, *_ in rows}
    for t in "ab":
        ids = np.flatnonzero(kind == t)
        for i, j in ids[kernels.delaunay_edges(xy[ids, 0] + (ids * 2654435761 % 1000) * 1e-9, xy[ids, 1] + (ids * 40503 % 1000) * 1e-9)].tolist():
            want |= {(i, j), (j, i)}
    assert got == want


def test_deconvolution_kernels_recover_a_mixture():
    rng = np.random.default_rng(0)
    s = rng.gamma(1.0, 1.0, (60, 3))
    s /= s.sum(0)
    true = np.array([0.6, 0.3, 0.1])
    y = rng.poisson(s @ true * 20_000).astype(float)
    for x in (kernels.nnls(s, y), kernels.dampened_wls(s, y, kernels.dampening_constant(s, y)), kernels.rctd_weights(s, np.minimum(y, 1e9), y.sum(), 0.1, most=1e9)):
        assert np.abs(x / x.sum() - true).max() < 0.08


def test_dampened_weights_by_hand():
    # Two types on three genes; the bulk is type 0 and half of type 1.
    s = np.array([[4.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
    y = s @ [1.0, 0.5]
    assert kernels.nnls(s, y) == pytest.approx([1.0, 0.5])
    # Predictions 4, 1, 1.5: weights 1/16, 1, 4/9, that is 1, 16, 64/9 times the least.
    assert kernels._prediction_weights(s, np.array([1.0, 0.5])) == pytest.approx([1, 16, 64 / 9])
    assert kernels._prediction_weights(s, np.array([1.0, 0.0])) == pytest.approx([1, 16, 16])
    for j in (1, 3, 5):
        assert kernels.dampened_wls(s, y, j) == pytest.approx([2 / 3, 1 / 3])
    # A bulk off the model: with the cap 1 the solution is the plain one, and a higher cap favours the small gene.
    off = np.array([4.0, 3.0, 0.5])
    plain = kernels.nnls(s, off)
    assert kernels.dampened_wls(s, off, 1) == pytest.approx(plain / plain.sum())
    assert kernels.dampened_wls(s, off, 6)[1] > plain[1] / plain.sum() + 0.01


def test_dampening_constant_is_the_evenest_of_resampled_fits():
    rng = np.random.default_rng(4)
    s, y = rng.gamma(1.0, 1.0, (30, 3)), rng.gamma(2.0, 1.0, 30)
    x = kernels.nnls(s, y)
    w = 1 / (s @ x) ** 2
    w /= w.min()
    draw, best = np.random.default_rng(0), (np.inf, 0)
    for j in range(1, int(np.ceil(np.log2(w.max()))) + 1):
        score = []
        for _ in range(50):
            h = draw.choice(30, 15, replace=False)
            c = np.linalg.lstsq(s[h], (y * np.minimum(w, 2 ** (j - 1)))[h], rcond=None)[0]
            c[c < 0] = 0
            score.append(c.std())
        best = min(best, (np.mean(score), j))
    assert kernels.dampening_constant(s, y) == best[1]


def mixture(spark, seed=1, spots=60, genes=40, types=3, total=3000):
    """Counts of spots mixed from known proportions, their type means, and the proportions."""
    rng = np.random.default_rng(seed)
    s = rng.gamma(0.4, 1.0, (genes, types)) + 0.02
    s /= s.sum(0)
    p = rng.dirichlet(np.ones(types) * 0.7, spots)
    y = rng.poisson((p @ s.T) * total)
    counts = spark.createDataFrame([(i, g, float(y[i, g])) for i in range(spots) for g in range(genes) if y[i, g]], "obs long, gene long, value double")
    means = spark.createDataFrame([(f"t{k}", g, float(s[g, k])) for g in range(genes) for k in range(types)], "cell_type string, gene long, mean double")
    return counts, means, s, p


def wide(df, spots, types):
    out = np.zeros((spots, types))
    for r in df.collect():
        out[r["obs"], int(r["cell_type"][1:])] = r["value"]
    return out


def test_dwls_per_cluster_uses_candidates_their_markers_and_one_cap(spark):
    counts, means, s, p = mixture(spark)
    assert np.abs(wide(deconv.dwls_deconv(counts, means), 60, 3) - p).mean() < 0.05
    clusters = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "obs long, cluster string")
    every = spark.range(60).select(F.col("id").alias("obs")).crossJoin(spark.range(40).select(F.col("id").alias("gene")))
    log = matrix.log_normalize(every.join(counts, ["obs", "gene"], "left").fillna(0.0, ["value"]))
    z = matrix.page_enrichment(log, matrix.marker_types(means), 60)
    got = wide(deconv.dwls_deconv(counts, means, clusters, log, cutoff=0.5), 60, 3)
    y = np.zeros((60, 40))
    for r in counts.collect():
        y[r["obs"], r["gene"]] = r["value"]
    top = z.join(clusters, "obs").groupBy("cluster", "cell_type").agg(F.max("z").alias("z")).collect()
    for c in "ab":
        best = sorted(((r["z"], r["cell_type"]) for r in top if r["cluster"] == c), reverse=True)
        own = sorted(int(t[1:]) for v, t in (best[:2] if sum(v > 0.5 for v, _ in best) < 2 else [b for b in best if b[0] > 0.5]))
        rows = np.flatnonzero(np.isin(s.argmax(1), own))
        sub, mine = s[np.ix_(rows, own)], [i for i in range(60) if "ab"[i % 2] == c]
        j = kernels.dampening_constant(sub, y[mine].mean(0)[rows])
        for i in mine:
            want = np.zeros(3)
            want[own] = kernels.dampened_wls(sub, y[i, rows], j)
            assert got[i] == pytest.approx(want)


def test_platform_effect_and_sigma(spark):
    counts, means, s, p = mixture(spark, seed=2, total=600)
    shift = np.exp(np.random.default_rng(0).normal(0, 0.5, 40))
    moved = counts.join(spark.createDataFrame([(g, float(x)) for g, x in enumerate(shift)], "gene long, shift double"), "gene").select("obs", "gene", F.round(F.col("value") * F.col("shift")).alias("value"))
    scaled = deconv.platform_effect(moved, means)
    got = {(r["cell_type"], r["gene"]): r["mean"] for r in scaled.collect()}
    ratio = np.array([got["t0", g] / s[g, 0] for g in range(40)])
    assert np.corrcoef(np.log(ratio), np.log(shift))[0, 1] > 0.95
    # In the bulk's proportions the scaled means give the bulk.
    bulk = np.array([r["total"] for r in matrix.bulk_vector(moved).orderBy("gene").collect()])
    x = np.maximum(kernels.rctd_weights(s[bulk >= 10], bulk[bulk >= 10], bulk.sum(), None, rounds=100, tol=1e-4), 0)
    assert np.array([[got[f"t{k}", g] for k in range(3)] for g in range(40)]) @ (x / x.sum()) == pytest.approx(bulk / bulk.sum())
    sigma = deconv.choose_sigma(counts, means, most_spots=20)
    assert sigma <= 0.5  # the counts have no lognormal factor
    genes = means.select("gene").distinct()
    assert np.abs(wide(deconv.rctd(counts, means, genes, genes), 60, 3) - p).mean() < 0.1
    with pytest.raises(ValueError):
        deconv.choose_sigma(counts, means, least_total=1e9)


def test_weights_that_sum_to_one_and_loss_of_a_poisson():
    rng = np.random.default_rng(5)
    d = rng.normal(size=(4, 4))
    d, c, low = d @ d.T + np.eye(4), rng.normal(size=4), -rng.random(4)
    x = kernels.sum_qp(d, c, low, 0.3)
    assert x.sum() == pytest.approx(0.3) and (x >= low - 1e-12).all()
    g = d @ x - c
    free = x > low + 1e-6
    assert np.ptp(g[free]) < 1e-5 and (g[~free] >= g[free].min() - 1e-5).all()
    y, mu = np.array([0.0, 1.0, 3.0]), np.array([0.5, 1.0, 2.0])
    want = -sum(k * np.log(m) - m - np.log(float(np.prod(np.arange(1, k + 1)))) for k, m in zip(y, mu))
    assert kernels.poisson_lognormal_loss(y, mu, 1e-6) == pytest.approx(want)
    s = rng.gamma(1.0, 1.0, (20, 3))
    assert kernels.rctd_weights(s / s.sum(0), np.round(s[:, 0] * 10), 200.0, 0.3, whole=True).sum() == pytest.approx(1.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.integers(1, 4))
def test_transport_is_of_least_cost(seed, n, m):
    rng = np.random.default_rng(seed)
    units = rng.integers(n + m, 9 + n + m)
    a, b = np.bincount(rng.integers(0, n, units), minlength=n), np.bincount(rng.integers(0, m, units), minlength=m)
    cost = rng.random((n, m)).round(2)
    plan = kernels.transport(a / units, b / units, cost)
    assert plan.sum(1) == pytest.approx(a / units) and plan.sum(0) == pytest.approx(b / units) and (plan >= 0).all()
    # A unit of mass each: an assignment of rows to the columns' places.
    rows = np.repeat(np.arange(n), a)
    best = cost[rows[:, None], np.arange(m)[None, :]]
    got = kernels.assign_with_quota(-best, b)
    assert (plan * cost).sum() * units == pytest.approx(best[np.arange(units), got].sum())


def test_quadrature_of_sharp_and_wide_integrands():
    z = np.linspace(-12, 12, 200_001)
    for y, mu, sigma in ((0, 0.5, 1.0), (3, 0.01, 1.5), (100, 300, 1.0), (100, 20, 0.3), (50, 50, 0.1), (1, 1e-4, 1.0)):
        f = lambda m: np.trapezoid(np.exp(-z * z / 2 + y * np.log(m * np.exp(sigma * z)) - m * np.exp(sigma * z) - np.log(np.arange(1, y + 1)).sum()), z) / np.sqrt(2 * np.pi)
        assert kernels.poisson_lognormal_loss(np.array([float(y)]), np.array([float(mu)]), sigma) == pytest.approx(-np.log(f(mu)), abs=1e-5)
        h = mu * 1e-4
        d1, d2 = kernels.poisson_lognormal_derivatives(np.array([float(y)]), np.array([float(mu)]), sigma)
        a, b, c = (np.log(f(m)) for m in (mu - h, mu, mu + h))
        assert d1[0] == pytest.approx((c - a) / (2 * h), rel=1e-3, abs=1e-6) and d2[0] == pytest.approx((c - 2 * b + a) / h**2, rel=2e-2, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(0, 99))
def test_quotas_dealt_to_blocks_keep_both_sums(total, seed):
    total = np.array(total)
    rng = np.random.default_rng(seed)
    sizes = np.bincount(rng.integers(0, 4, total.sum()), minlength=4)
    got = kernels.deal_quotas(total, sizes)
    assert (got.sum(0) == total).all() and (got.sum(1) == sizes).all() and (got >= 0).all()


def tissue(spark, seed=3, n=70):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 60, (n, 2))
    cells = spark.createDataFrame([(i, float(x), float(y), int(rng.integers(0, 6)), "ab"[i % 2]) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double, img_type int, cell_type string")
    at = [(k, 15.0 + 15 * (k % 3), 15.0 + 15 * (k // 3)) for k in range(9)]
    spots = spark.createDataFrame(at, "spot_id long, x double, y double")
    grid = [(100 + i * 20 + j, 3.0 * i, 3.0 * j) for i in range(20) for j in range(17)]  # nothing above y = 48 + 2
    points = spark.createDataFrame(grid, "point_id long, x double, y double")
    share = lambda ids: [(i, t, float(p)) for i in ids for t, p in zip("abc", rng.dirichlet([1, 1, 1]))]
    ratios, point_ratios = share(range(9)), share(p for p, _, _ in grid)
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, cell_type string, value double")
    return xy, at, grid, dict(((i, t), p) for i, t, p in ratios), dict(((i, t), p) for i, t, p in point_ratios), cells, spots, frame(ratios, "spot_id"), points, frame(point_ratios, "point_id")


def hamilton(shares, total):
    raw = np.array(shares) / sum(shares) * total
    out = np.floor(raw).astype(int)
    for k in sorted(range(len(raw)), key=lambda k: (-round(raw[k] - out[k], 9), k))[: total - out.sum()]:
        out[k] += 1
    return out


@pytest.mark.parametrize("sample,classes,alpha", [(2000, 500, None), (5, 2, None), (2000, 500, 0.3)])
def test_the_annotator_meets_spot_and_global_quotas_at_the_greatest_score(spark, monkeypatch, sample, classes, alpha):
    monkeypatch.setattr(assign, "SAMPLE", sample)
    monkeypatch.setattr(assign, "CLASSES", classes)
    xy, at, grid, ratios, point_ratios, cells, spots, spot_frame, points, point_frame = tissue(spark)
    got = {r["cell_id"]: (r["pred_cell_type"], r["spot_id"]) for r in annotate.annotate_cells(cells, spots, spot_frame, points, point_frame, 5.0, 2.0, list("abc"), alpha).collect()}
    near = {i: [p for p, a, b in grid if max(abs(a - x), abs(b - y)) <= 2.0] for i, (x, y) in enumerate(xy)}
    kept = [i for i in near if near[i]]
    assert sorted(got) == kept and 0 < len(kept) < len(xy)
    inside = {}
    for i in kept:
        d = sorted((np.hypot(*(xy[i] - [a, b])), k) for k, a, b in at)
        if d[0][0] <= 5.0:
            inside.setdefault(d[0][1], []).append(i)
    quota = {k: hamilton([ratios[k, t] for t in "abc"], len(c)) for k, c in inside.items()}
    whole = hamilton(sum(quota.values()), len(kept))
    for k, c in inside.items():
        assert all(got[i][1] == k for i in c) and [sum(got[i][0] == t for i in c) for t in "abc"] == quota[k].tolist()
    assert [sum(t == x for x, _ in got.values()) for t in "abc"] == whole.tolist()
    if alpha is None:
        n = {p: sum(p in near[i] for i in kept) for p, _, _ in grid}
        score = np.array([[sum(point_ratios[p, t] / n[p] for p in near[i]) for t in "abc"] for i in kept])
        row = {i: k for k, i in enumerate(kept)}
        value = lambda ids: sum(score[row[i], "abc".index(got[i][0])] for i in ids)
        out = [i for i in kept if got[i][1] is None]
        left = whole - sum(quota.values())
        for ids, q in [*((c, quota[k]) for k, c in inside.items()), (out, left)]:
            best = kernels.assign_with_quota(score[[row[i] for i in ids]], q)
            assert value(ids) == pytest.approx(score[[row[i] for i in ids], best].sum())


def test_assignments_that_cannot_be_met_raise(spark):
    scores = spark.createDataFrame([(i, t, 1.0) for i in range(4) for t in "ab"], "cell_id long, cell_type string, score double")
    member = spark.createDataFrame([(0, 1), (1, 1)], "cell_id long, spot_id long")
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} quota long")
    quotas = frame([(1, "a", 2)], "spot_id long, cell_type string,")
    run = lambda q, t: annotate.constrained_assignment(scores, member, q, ["a", "b"], frame(t, "cell_type string,")).collect()
    assert len(run(quotas, [("a", 3), ("b", 1)])) == 4
    with pytest.raises(ValueError, match="exceed"):
        run(quotas, [("a", 1), ("b", 3)])
    with pytest.raises(ValueError, match="leave"):
        run(quotas, [("a", 3), ("b", 2)])
    with pytest.raises(ValueError, match="has 2 cells"):
        run(frame([(1, "a", 1)], "spot_id long, cell_type string,"), [("a", 3), ("b", 1)])


def test_transfer_by_exact_and_entropic_transport(spark):
    cost = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 0.0)], "cell_type string, morphology string, cost double")
    share = lambda c, u, v: spark.createDataFrame([(c[0], u), (c[1], v)], "cell_type string, value double" if c == "ab" else "morphology string, value double")
    got = {(r[0], r[1]): r[2] for r in annotate.type_transfer(cost, share("ab", 3.0, 1.0), share("xy", 1.0, 1.0)).collect()}
    assert got == pytest.approx({("a", "x"): 1.0, ("b", "x"): 0.0, ("a", "y"): 0.5, ("b", "y"): 0.5})
    soft = {(r[0], r[1]): r[2] for r in annotate.type_transfer(cost, share("ab", 3.0, 1.0), share("xy", 1.0, 1.0), "sinkhorn").collect()}
    assert soft == pytest.approx(got, abs=1e-3)


def test_the_predictor_follows_the_loop(spark):
    xy, at, _, ratios, _, cells, spots, spot_frame, _, _ = tissue(spark, n=50)
    rng = np.random.default_rng(8)
    mean, y = rng.gamma(1.0, 1.0, (2, 4)), rng.poisson(5.0, (9, 4)).astype(float)
    means = spark.createDataFrame([("ab"[k], g, float(mean[k, g])) for k in range(2) for g in range(4)], "cell_type string, gene long, mean double")
    counts = spark.createDataFrame([(s, g, float(y[s, g])) for s in range(9) for g in range(4)], "spot_id long, gene long, value double")
    props = spot_frame.where("cell_type <> 'c'")
    got = {}
    for r in predict.predict_expression(spots, counts, props, means, cells, 6.0).collect():
        got[r["cell_id"], r["gene"]] = (r["labeled"], r["value"])
    beta = np.array([[ratios[s, t] for t in "ab"] for s in range(9)])
    split = beta.T[:, :, None] * mean[:, None, :]
    split = split * y / split.sum(0)
    split = np.log1p(split / (split.sum(2, keepdims=True) + 1e-3) * 1e4)
    centre = np.array([(a, b) for _, a, b in at])
    for k, t in enumerate("ab"):
        ids = np.array([i for i in range(50) if "ab"[i % 2] == t])
        d = np.hypot(*(xy[ids][:, None] - centre[None]).transpose(2, 0, 1))
        labeled = d.min(1) <= 6.0
        v = np.zeros((len(ids), 4))
        for i in range(len(ids)):
            far = d[i] <= 24.0
            v[i] = split[k, d[i].argmin()] if labeled[i] else split[k, far].mean(0) if far.any() else 0
        w = np.zeros((len(ids), len(ids)))
        for i, j in kernels.delaunay_edges(xy[ids, 0] + (ids * 2654435761 % 1000) * 1e-9, xy[ids, 1] + (ids * 40503 % 1000) * 1e-9).tolist():
            w[i, j] = w[j, i] = 1 / (np.hypot(*(xy[ids[i]] - xy[ids[j]])) + 1e-6)
        w[np.diag_indices(len(ids))] = w.sum(1) / (w > 0).sum(1)
        w /= w.sum(1, keepdims=True)
        best, wait, keep = np.inf, 0, 1 / 1.1
        for _ in range(20):
            new = np.where(labeled[:, None], keep * v + (1 - keep) * (w @ v), w @ v)
            diff = ((new - v)[~labeled] ** 2).mean()
            best, wait = (diff, 0) if diff < best - 1e-4 else (best, wait + 1)
            if wait >= 5:
                break
            v = new
        for i, c in enumerate(ids.tolist()):
            assert [got[c, g][0] for g in range(4)] == [labeled[i]] * 4
            assert [got[c, g][1] for g in range(4)] == pytest.approx(v[i], abs=1e-4)


def test_cell_status_and_edges(spark):
    boxes = [(10, 10, 40, 40, 1), (100, 100, 140, 140, 0), (200, 200, 240, 240, 5)]
    df = spark.createDataFrame(boxes, "rmin int, cmin int, rmax int, cmax int, want int")
    got = df.select(detect.cell_status(F.col("rmin"), F.col("cmin"), F.col("rmax"), F.col("cmax")).alias("s"), "want").collect()
    assert all(r["s"] == r["want"] for r in got)
    one = spark.range(1).select(detect.edge_patches(F.array(F.lit(1), F.lit(0), F.lit(0), F.lit(1)), F.lit(2), F.lit(3)).alias("e")).first()["e"]
    assert one == [[2, 2], [1, 2], [1, 3]]


def test_overlap_dedup_matches_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(r), int(c), int(r + h), int(c + w)) for i, (r, c, h, w) in enumerate(zip(rng.integers(0, 60, 80), rng.integers(0, 60, 80), rng.integers(2, 12, 80), rng.integers(2, 12, 80)))]
    got = sorted(r[0] for r in detect.overlap_dedup(spark.createDataFrame(rows, "cell_id long, rmin long, cmin long, rmax long, cmax long"), cell=16.0).select("cell_id").collect())
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    common = lambda a, b: max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
    kept = []
    for b in sorted(rows, key=lambda b: (-area(b), b[0])):
        if not any(common(a, b) > 0.01 * min(area(a), area(b)) for a in kept):
            kept.append(b)
    assert got == sorted(b[0] for b in kept)


def test_cache_follows_content(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    for df in (a, a.orderBy(F.desc("k")), a.union(a.limit(1))):
        assert io.cached(str(tmp_path), [df], {"radius": 3}, build).count() == 3
    assert len(made) == 2


def test_common_area_of_polygons():
    square = np.array([0.0, 4, 4, 0]), np.array([0.0, 0, 4, 4])
    ell = np.array([0.0, 6, 6, 2, 2, 0]), np.array([0.0, 0, 2, 2, 6, 6])
    assert kernels.polygon_area(*ell) == 20 and kernels.common_area(*square, *ell) == pytest.approx(12)
    assert kernels.common_area(*square, *square) == pytest.approx(16) and kernels.common_area(*ell, *(v + 9 for v in square)) == 0
    comb = np.array([0.0, 7, 7, 5, 5, 4, 4, 2, 2, 0]), np.array([0.0, 0, 5, 5, 1, 1, 5, 5, 1, 1])
    bar = np.array([-1.0, 8, 8, -1]), np.array([2.0, 2, 3, 3])
    assert kernels.common_area(*comb, *bar) == pytest.approx(4)
    rng = np.random.default_rng(6)
    for _ in range(20):
        stars = []
        for _ in range(2):
            a = np.sort(rng.uniform(0, 2 * np.pi, 9))
            r = rng.uniform(0.3, 1, 9)
            stars.append((r * np.cos(a) + rng.uniform(-0.3, 0.3), r * np.sin(a)))
        inside = lambda x, y, px, py: np.logical_xor.reduce([((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay)) for ax, ay, bx, by in zip(x, y, np.roll(x, -1), np.roll(y, -1))])
        g = (np.arange(600) + 0.5) / 600 * 2.8 - 1.4
        px, py = np.meshgrid(g, g)
        count = (inside(*stars[0], px, py) & inside(*stars[1], px, py)).sum() * (2.8 / 600) ** 2
        assert kernels.common_area(*stars[0], *stars[1]) == pytest.approx(count, abs=0.02)


def test_polygon_overlaps_match_brute_force(spark):
    rng = np.random.default_rng(7)
    shapes = []
    for i in range(60):
        a = np.sort(rng.uniform(0, 2 * np.pi, 6))
        shapes.append((i, (rng.uniform(0, 50) + 5 * np.cos(a)).tolist(), (rng.uniform(0, 50) + 5 * np.sin(a)).tolist()))
    df = spark.createDataFrame([*shapes, (100, [1.0, 2.0], [1.0, 2.0]), (101, None, None)], "cell_id long, xs array<double>, ys array<double>")
    got = {(r["cell_id"], r["b_cell_id"]): r["common"] for r in detect.polygon_overlap_pairs(df, cell=16.0).collect()}
    want = {}
    for (i, ax, ay), (j, bx, by) in itertools.combinations(shapes, 2):
        a, b = (np.array(ax), np.array(ay)), (np.array(bx), np.array(by))
        c = kernels.common_area(*a, *b)
        if c > 0.01 * min(kernels.polygon_area(*a), kernels.polygon_area(*b)):
            want[i, j] = c
    assert got == pytest.approx(want) and len(want) > 10
    kept = sorted(r["cell_id"] for r in detect.overlap_dedup(df, cell=16.0, polygons=True).collect())
    assert not any((i, j) in want for i, j in itertools.combinations(kept, 2)) and {100, 101} <= set(kept)


def test_small_checks(spark):
    a = spark.createDataFrame([(1, "s"), (2, "t")], "obs long, slide string")
    assert [r["obs"] for r in spatial.select_slide(a, "t").collect()] == [2]
    with pytest.raises(ValueError):
        spatial.select_slide(a, "u")
    spatial.check_ids(a, a)
    with pytest.raises(ValueError, match="1 ids are in the first table only, 0"):
        spatial.check_ids(a, a.where("obs = 1"))
    tests = spark.createDataFrame([(1, 0.01), (2, 0.05), (3, None)], "id int, p_adjust double")
    assert [r["id"] for r in stats.significant(tests).collect()] == [1]
    wide = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0.2, 3.0, 100.0, 0.0])], "query_id long, r double").withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    base = points(spark, [(k, float(k), 0.0) for k in range(0, 120, 3)], "base_id")
    got = {(r[0], r[1]) for r in spatial.radius_join(wide, base, "r").collect()}
    assert got == {(i, k) for i, x in enumerate([0.2, 3.0, 100.0, 0.0]) for k in range(0, 120, 3) if k <= x}


def test_doublets_and_singlets(spark):
    rng = np.random.default_rng(9)
    s = rng.gamma(0.4, 1.0, (50, 4)) + 0.02
    s /= s.sum(0)
    mix = [[1, 0, 0, 0], [0, 0, 1, 0], [0.5, 0.5, 0, 0], [0, 0.4, 0, 0.6], [0, 0, 0, 1]]
    y = rng.poisson(np.array(mix) @ s.T * 800)
    counts = spark.createDataFrame([(i, g, float(y[i, g])) for i in range(5) for g in range(50)], "obs long, gene long, value double")
    means = spark.createDataFrame([(f"t{k}", g, float(s[g, k])) for g in range(50) for k in range(4)], "cell_type string, gene long, mean double")
    got = {r["obs"]: r for r in deconv.rctd_doublet(counts, means, 0.1).collect()}
    for i, m in enumerate(mix):
        r, own = got[i], {f"t{k}" for k in range(4) if m[k]}
        if len(own) == 1:
            assert r["spot_class"] == "singlet" and r["first_type"] in own and r["first_weight"] > 0.8
        else:
            assert r["spot_class"] == "doublet_certain" and {r["first_type"], r["second_type"]} == own
            assert r["first_weight"] == pytest.approx(m[int(r["first_type"][1])], abs=0.12) and r["singlet_score"] - r["min_score"] >= kernels.DOUBLET
    # A type whose copy does as well isn't sure, but its class is.
    twin = means.unionByName(means.where("cell_type = 't0'").withColumn("cell_type", F.lit("t0b")))
    classes = spark.createDataFrame([("t0", "x"), ("t0b", "x")], "cell_type string, class string")
    plain = deconv.rctd_doublet(counts.where("obs = 2"), twin, 0.1).first()
    kin = deconv.rctd_doublet(counts.where("obs = 2"), twin, 0.1, classes).first()
    assert plain["spot_class"] == "doublet_uncertain" and plain["first_type"] == "t1" and kin["spot_class"] == "doublet_certain"


def test_overlap_removal_of_a_long_chain_ends_with_no_pair(spark):
    """Ninety boxes of rising area, each over its neighbours only: every second one stays."""
    rows = [(i, 0, 10 * i, 100 + i, 10 * i + 14) for i in range(90)]
    df = spark.createDataFrame(rows, "cell_id long, rmin long, cmin long, rmax long, cmax long")
    left = detect.overlap_dedup(df)
    assert sorted(r["cell_id"] for r in left.collect()) == list(range(1, 90, 2))
    assert detect.overlap_pairs(left).count() == 0


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_cells_at_one_place_are_linked_as_in_one_triangulation(spark, far):
    """Ids that agree modulo a thousand, at one place, near the origin and far from it."""
    rng = np.random.default_rng(8)
    rows = [(k, far + 5.0, far + 5.0) for k in (0, 1000, 2000, 2**40, 2**62)] + [(10 + i, far + float(a), far + float(b)) for i, (a, b) in enumerate(rng.uniform(0, 10, (30, 2)))]
    cells = spark.createDataFrame([(*r, "A") for r in rows], "cell_id long, x double, y double, cell_type string")
    for tile, halo in ((40.0, 40.0), (4.0, 4.0)):
        edges = {(r[0], r[1]) for r in predict.delaunay_graph(cells, tile, halo).select("src", "dst").collect()}
        own = [r[0] for r in rows[:5]]
        for a in own:  # connected with the others at the place
            seen, todo = set(), [a]
            while todo:
                n = todo.pop()
                if n not in seen:
                    seen.add(n)
                    todo += [b for b in own if (n, b) in edges or (b, n) in edges]
            assert seen == set(own)
        undirected = {tuple(sorted(e)) for e in edges}
        assert tile == 40.0 or undirected == whole
        whole = undirected


def test_rank_sums_of_millions_of_cells_do_not_overflow(spark):
    """3.5 million cells of two types: n1 (n - n1) (n + 1) is beyond 64 bits."""
    n = 3_500_000
    labels = spark.range(n).select(F.col("id").alias("obs"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cell_type"))
    counts = spark.createDataFrame([(0, 1, 5.0), (2, 1, 3.0), (1, 2, 4.0)], "obs long, gene long, value double")
    z = {(r.cell_type, r.gene): r.z for r in matrix.wilcoxon_markers(counts, labels).collect()}
    half, sd = n / 2, (n / 2 * (n / 2) * (n + 1) / 12) ** 0.5
    assert abs(z["a", 1] - half / sd) < 1e-9 and abs(z["b", 1] + half / sd) < 1e-9
    assert abs(z["b", 2] - half / 2 / sd) < 1e-9
