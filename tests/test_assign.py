"""The assignment of any number of rows against the one-process optimum and the conditions of optimality."""

import time

import numpy as np
import pytest

from spotweave.functions import kernels
from spotweave.operators import assign


def table(spark, score):
    return spark.createDataFrame([(int(i) * 3, *map(float, row)) for i, row in enumerate(score)], "cell_id long, " + ", ".join(f"s{j} double" for j in range(score.shape[1])))


def total(spark, score, quota, parts=4):
    got = {r[0] // 3: r[1] for r in assign.assign(table(spark, score).repartition(parts), [f"s{j}" for j in range(score.shape[1])], quota).collect()}
    at = np.array([got[i] for i in range(len(score))])
    assert np.bincount(at, minlength=score.shape[1]).tolist() == quota.tolist()
    return score[np.arange(len(score)), at].sum(), at


@pytest.mark.parametrize("seed,n,k,sample,classes", [(1, 300, 4, 2000, 500), (2, 300, 5, 20, 500), (3, 250, 3, 10, 4), (4, 300, 4, 30, 7)])
def test_total_score_is_the_optimum(spark, monkeypatch, seed, n, k, sample, classes):
    """Prices of all rows or of a few, and one round of moves or many; ties and a class of a third of all rows."""
    monkeypatch.setattr(assign, "SAMPLE", sample)
    monkeypatch.setattr(assign, "CLASSES", classes)
    monkeypatch.setattr(assign, "RANKED", 20)
    rng = np.random.default_rng(seed)
    score = rng.random((n, k)) if seed < 3 else rng.integers(0, 4, (n, k)) / 4
    score[: n // 3] = score[0]
    quota = rng.multinomial(n, rng.dirichlet(np.ones(k)))
    best = score[np.arange(n), kernels.assign_with_quota(score, quota)].sum()
    ours, at = total(spark, score, quota)
    assert abs(ours - best) < 1e-9
    assert (total(spark, score, quota, 1)[1] == at).all()


def test_no_cycle_of_types_gains_on_many_rows(spark):
    """20,000 rows: by the prices that follow, every row is content, which only an optimum allows."""
    rng = np.random.default_rng(5)
    score = rng.random((20_000, 4)) * [1, 0.9, 1.2, 0.5]
    quota = np.array([9000, 7000, 1500, 2500])
    _, at = total(spark, score, quota)
    price = assign.prices(score, at)
    worth = score - price
    assert (worth[np.arange(len(at)), at] >= worth.max(1) - 1e-9).all()


def test_no_rows_and_one_type(spark):
    assert assign.assign(table(spark, np.zeros((0, 2))), ["s0", "s1"], np.array([0, 0])).collect() == []
    ours, at = total(spark, np.ones((5, 1)), np.array([5]))
    assert ours == 5 and (at == 0).all()


def test_a_large_group_is_dealt_in_time_and_as_unit_by_unit():
    """30,000 rows of one spot: every moved row once cost a pass over all rows."""
    rng = np.random.default_rng(6)
    score = rng.random((30_000, 5))
    quota = rng.multinomial(30_000, [0.5, 0.3, 0.1, 0.05, 0.05])
    began = time.process_time()
    at = kernels.assign_with_quota(score, quota)
    assert time.process_time() - began < 12
    assert np.bincount(at, minlength=5).tolist() == quota.tolist()
    price = assign.prices(score, at)
    worth = score - price
    assert (worth[np.arange(len(at)), at] >= worth.max(1) - 1e-9).all()
