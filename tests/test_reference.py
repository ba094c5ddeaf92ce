"""Negative binomial regression: closed forms, planted means, and an objective that rises."""

import math

import numpy as np
import pytest

from spotweave.functions import counts as C
from spotweave.operators import reference


def test_log_gamma_and_likelihood():
    x = np.array([1e-4, 0.3, 1, 2, 7.9, 8, 123.4, 1e6])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    for mean, kappa in ((3.0, 0.7), (0.2, 2.0), (50.0, 0.1), (4.0, 1e-3)):
        p = np.exp(C.log_likelihood(np.arange(4000.0), np.full(4000, mean), kappa))
        assert abs(p.sum() - 1) < 1e-6 and abs((p * np.arange(4000)).sum() - mean) < 1e-3 * mean
    assert abs(C.log_likelihood(np.array([0.0]), np.array([0.0]), 0.5)[0]) < 1e-9


def simulated(seed, cells=240, genes=15, kinds=3, batches=2):
    rng = np.random.default_rng(seed)
    mu, add = rng.gamma(1, 4, (kinds, genes)), rng.gamma(1, 0.1, (batches, genes))
    kind, batch = rng.integers(0, kinds, cells), rng.integers(0, batches, cells)
    y, alpha = np.array([1.0, 0.5])[:batches], rng.uniform(2, 6, genes)
    mean = (mu[kind] + add[batch]) * y[batch][:, None]
    return mu, kind, batch, rng.poisson(mean * rng.gamma(alpha, 1 / alpha, mean.shape))


def tables(spark, kind, batch, x):
    counts = spark.createDataFrame([(int(i), f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(9999, "g00", 5.0)], "obs long, gene string, value double")
    labels = [(i, f"t{k}", f"b{b}") for i, (k, b) in enumerate(zip(kind.tolist(), batch.tolist()))] + [(8888, None, "b0")]
    return counts, spark.createDataFrame(labels, "obs long, cell_type string, batch string")


def test_planted_means_come_back_and_the_objective_rises(spark):
    mu, kind, batch, x = simulated(1)
    counts, labels = tables(spark, kind, batch, x)
    means, genes, objective = reference.nb_reference(counts.repartition(3), labels, rounds=8)
    got = means.toPandas().pivot(index="cell_type", columns="gene", values="mean").to_numpy()
    scale = (got.sum() / mu.sum())  # detections and means share one free factor
    assert np.median(np.abs(got / scale - mu) / (mu + 0.3)) < 0.15
    assert len(objective) == 8 and all(b >= a - 1e-6 for a, b in zip(objective, objective[1:])) and objective[-1] > objective[0]
    assert genes.count() == 15 and all(0.3 < r["dispersion"] < 100 and len(r["additive"]) == 2 for r in genes.collect())


def test_one_batch_ends_where_no_parameter_gains(spark):
    mu, kind, batch, x = simulated(2, batches=1)
    counts, labels = tables(spark, kind, batch, x)
    means, genes, objective = reference.nb_reference(counts, labels.drop("batch"), rounds=30, steps=200)
    assert 1 < len(objective) <= 30
    got = means.toPandas().pivot(index="gene", columns="cell_type", values="mean")
    cells = np.bincount(kind).reshape(-1, 1).astype(float)
    for row in genes.collect():
        j = int(row["gene"][1:])
        n = {}
        for k, v in zip(kind.tolist(), x[:, j].tolist()):
            if v:
                n[k, v] = n.get((k, v), 0) + 1
        g = C.GeneCounts(np.array([k for k, _ in n]), np.zeros(len(n), int), np.array([v for _, v in n], float), np.array(list(n.values()), float), cells)
        now = [got.loc[row["gene"]].to_numpy(), np.array(row["additive"]), row["dispersion"] ** -0.5]
        best = g.objective(*now, np.ones(1), 0.1)
        for part in range(2):
            for k in range(len(now[part])):
                for f in (0.97, 1.03):
                    other = [v.copy() if isinstance(v, np.ndarray) else v for v in now]
                    other[part][k] *= f
                    assert g.objective(*other, np.ones(1), 0.1) < best + 1e-2
        assert g.objective(now[0], now[1], now[2] * 1.05, np.ones(1), 0.1) < best + 1e-2


def test_no_counts_and_no_labels(spark):
    counts, labels = tables(spark, np.zeros(3, int), np.zeros(3, int), np.ones((3, 1), int))
    for c, l in ((counts.where("false"), labels), (counts, labels.where("false"))):
        means, genes, objective = reference.nb_reference(c, l)
        assert means.collect() == [] and genes.collect() == [] and objective == []


@pytest.mark.parametrize("seed", [3, 4])
def test_each_step_raises_the_objective(seed):
    rng = np.random.default_rng(seed)
    cells = rng.integers(20, 60, (3, 2)).astype(float)
    n = 30
    g = C.GeneCounts(rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(1, 30, n).astype(float), np.ones(n), cells)
    y, now, last = np.array([1.0, 0.6]), g.start(), -np.inf
    for _ in range(60):
        now = g.improve(*now, y, 0.1, 1)
        value = g.objective(*now, y, 0.1)
        assert value >= last - 1e-8
        last = value
