"""Components, neighbours, the fuzzy graph and communities against numpy loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import communities, embed

SF = "/root/testdata/sf0.001"


def vectors(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"obs {kind}, vector array<double>")


def test_components_match_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 12)) + rng.normal(size=(60, 12)) * 0.1
    x[rng.random(x.shape) < 0.3] = 0
    rows = [(int(i), f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    scores, axes, variances = embed.pca(spark.createDataFrame(rows, "obs long, gene string, value double").repartition(5), 4)
    got = {r[0]: r[1] for r in scores.collect()}
    centred = x - x.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(1)])
    assert np.allclose([got[i] for i in range(60)], centred @ vt[:4].T * sign) and np.allclose(variances, s[:4] ** 2 / 59)
    assert np.allclose(axes.to_numpy(), vt[:4].T * sign)
    none = embed.pca(spark.createDataFrame([], "obs long, gene string, value double"))
    assert none[0].collect() == [] and len(none[2]) == 0
    with pytest.raises(ValueError):
        embed.pca(spark.range(embed.GENES + 1).select(F.lit(1).alias("obs"), F.col("id").alias("gene"), F.lit(1.0).alias("value")))


def brute_nearest(rows, k):
    x = {i: np.array(v) for i, v in rows if v is not None}
    out = []
    for i in x:
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in x if j != i)[:k]
        out += [(i, j, round(d, 9), n) for n, (d, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,pivots,k", [(1024, 1024, 5), (7, 4, 3), (5, 30, 14)])
def test_neighbours_match_brute_force(spark, monkeypatch, block, pivots, k):
    """Clustered, equal and far points, in blocks of any size."""
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "PIVOTS", pivots)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, 0.3, size=(25, 3)) for c in (0, 2, 9)] + [np.zeros((40, 3)), rng.integers(0, 3, size=(30, 3)), [[500.0, 0, 0]]])
    rows = [(i * 7 % 400, [float(v) for v in p]) for i, p in enumerate(x)] + [(1000, None)]
    got = embed.nearest(vectors(spark, rows).repartition(3), k)
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()) == brute_nearest(rows, k)


def test_few_points_and_other_ids(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0])]
    got = sorted(map(tuple, embed.nearest(vectors(spark, rows, "string"), 5).collect()))
    assert got == [("a", "b", 1.0, 1), ("a", "c", 1.0, 2), ("b", "c", 0.0, 1), ("b", "a", 1.0, 2), ("c", "b", 0.0, 1), ("c", "a", 1.0, 2)] or sorted(got) == sorted([("a", "b", 1.0, 1), ("a", "c", 1.0, 2), ("b", "c", 0.0, 1), ("b", "a", 1.0, 2), ("c", "b", 0.0, 1), ("c", "a", 1.0, 2)])
    assert embed.nearest(vectors(spark, [(1, [1.0])]), 3).collect() == []
    assert embed.nearest(vectors(spark, []), 3).collect() == []


def test_fuzzy_graph_is_the_union_of_strengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=2)]) for i in range(40)]
    near = brute_nearest(rows, 5)
    one = {}
    for i in range(40):
        d = np.array([[x[2] for x in near if x[0] == i]])
        w = embed.membership(d, 6)[0]
        assert w.max() == 1 and abs(w.sum() - np.log2(6)) < 1e-6
        one.update({(i, x[1]): v for x, v in zip([x for x in near if x[0] == i], w)})
    got = {(r[0], r[1]): r[2] for r in embed.fuzzy_graph(spark.createDataFrame([x[:3] for x in near], "obs long, neighbor long, distance double"), 6).collect()}
    want = {}
    for (a, b) in one:
        x, y = one.get((a, b), 0.0), one.get((b, a), 0.0)
        want[a, b] = want[b, a] = x + y - x * y
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def loop_quality(edges, label, resolution):
    whole = sum(edges.values())
    strength, inside = {}, 0.0
    for (a, b), w in edges.items():
        strength[label[a]] = strength.get(label[a], 0.0) + w
        inside += w * (label[a] == label[b])
    return inside / whole - resolution * sum(s * s for s in strength.values()) / whole**2


def loop_communities(edges, nodes, resolution, seed):
    """One node after the other, levels of aggregation, until no move gains."""
    r, label = random.Random(seed), {n: n for n in nodes}
    level, own = dict(edges), {n: n for n in nodes}
    while True:
        whole = sum(level.values())
        names = sorted({a for e in level for a in e})
        c = {n: n for n in names}
        k = {n: sum(w for (a, _), w in level.items() if a == n) for n in names}
        near = {n: {} for n in names}
        for (a, b), w in level.items():
            if a != b:
                near[a][b] = w
        total, moved = dict(k), True
        while moved:
            moved = False
            for n in r.sample(names, len(names)):
                to = {}
                for b, w in near[n].items():
                    to[c[b]] = to.get(c[b], 0.0) + w
                total[c[n]] -= k[n]
                best = max([c[n], *to], key=lambda x: to.get(x, 0.0) - resolution * k[n] * total[x] / whole)
                if to.get(best, 0.0) - resolution * k[n] * total[best] / whole > to.get(c[n], 0.0) - resolution * k[n] * total[c[n]] / whole + 1e-12:
                    c[n], moved = best, True
                total[c[n]] += k[n]
        if all(c[n] == n for n in names):
            return own
        own = {n: c.get(own[n], own[n]) for n in own}
        new = {}
        for (a, b), w in level.items():
            new[c[a], c[b]] = new.get((c[a], c[b]), 0.0) + w
        level = new


def planted(seed, groups=6, size=12):
    r = random.Random(seed)
    edges = {}
    for a, b in itertools.combinations(range(groups * size), 2):
        if r.random() < (0.5 if a // size == b // size else 0.03):
            edges[a, b] = edges[b, a] = round(r.uniform(0.5, 1.5), 3)
    return edges


def connected(nodes, edges):
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n and b in nodes]
    return seen == set(nodes)


def test_communities_are_connected_and_no_worse_than_a_loop(spark):
    edges = planted(1, 4, 9)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double")
    lonely = spark.createDataFrame([(0,), (500,)], "node long")
    got = {r[0]: r[1] for r in communities.leiden(df, lonely, 1.0).collect()}
    assert got[500] == max(got.values()) and sum(v == got[500] for v in got.values()) == 1
    assert set(got) == {a for a, _ in edges} | {0, 500}
    for c in set(got.values()):
        assert connected({n for n in got if got[n] == c}, edges)
    sizes = [sum(v == c for v in got.values()) for c in range(max(got.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True)
    ours = loop_quality(edges, got, 1.0)
    assert abs(ours - communities.quality(df, spark.createDataFrame(list(got.items()), "node long, label long"))) < 1e-9
    assert ours >= max(loop_quality(edges, loop_communities(edges, sorted({a for a, _ in edges}), 1.0, s), 1.0) for s in range(3)) - 1e-9


def test_no_edges_a_chain_and_components(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert sorted(map(tuple, communities.leiden(none, spark.createDataFrame([(7,), (3,)], "n long")).collect())) == [(3, 0), (7, 1)]
    chain = [(a, b) for i in range(60) for a, b in ((i, i + 1), (i + 1, i))] + [(100, 101), (101, 100)]
    df, nodes = spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "node long")
    got = dict(map(tuple, communities.components(df, nodes).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
