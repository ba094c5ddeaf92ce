import numpy as np
import pytest

from spotweave.functions import kernels
from spotweave.operators import deconv


@pytest.mark.parametrize("sigma", [0.1, 0.5, 1.0, 2.0])
def test_table_gives_the_quadratures_derivatives(spark, sigma):
    table = deconv.likelihood_table(spark, sigma).value
    rng = np.random.default_rng(3)
    y, mu = rng.integers(0, 101, 20_000).astype(float), np.exp(rng.uniform(np.log(1e-4), np.log(9e4), 20_000))
    got, want = table.derivatives(y, mu), kernels.poisson_lognormal_derivatives(y, mu, sigma)
    # In units of log mu, against the count.
    assert np.abs((got[0] - want[0]) * mu / (1 + y)).max() < 1e-6
    assert np.abs((got[1] - want[1]) * mu * mu / (1 + y)).max() < 1e-3


def test_counts_and_means_beyond_the_table_take_the_quadrature(spark):
    table = deconv.likelihood_table(spark, 0.7).value
    y, mu = np.array([101.0, 2.5, 3.0, 3.0, 0.0, 100.0]), np.array([50.0, 2.0, 1e-5, 2e5, 1.0, 80.0])
    got, want = table.derivatives(y, mu), kernels.poisson_lognormal_derivatives(y, mu, 0.7)
    assert [g[:4].tolist() for g in got] == [w[:4].tolist() for w in want]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-7)
    assert all(len(d) == 0 for d in table.derivatives(np.zeros(0), np.zeros(0)))


def test_weights_with_and_without_the_table_agree(spark):
    rng = np.random.default_rng(5)
    s = rng.gamma(0.5, 1, (200, 4))
    s /= s.sum(0)
    table = deconv.likelihood_table(spark, 0.4).value
    for k in range(10):
        y = rng.poisson(s @ rng.dirichlet(np.ones(4)) * 800 * rng.lognormal(0, 0.4, 200)).astype(float)
        a, b = (kernels.rctd_weights(s, y, y.sum(), 0.4, whole=k % 2 == 0, table=t) for t in (None, table))
        assert np.abs(a - b).max() < 1e-5
        a, b = (kernels.doublet(s, y, y.sum(), 0.4, table=t) for t in (None, table))
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-3)


@pytest.mark.parametrize("sigma", [0.1, 0.3])
def test_quadrature_finds_far_modes(sigma):
    z = np.linspace(-120, 60, 3_000_001)
    for y, mu in [(100, 1e-3), (40, 0.02), (1, 900.0), (0, 5e4), (100, 5e4)]:
        log_p = y * (np.log(mu) + sigma * z) - mu * np.exp(sigma * z) - z * z / 2
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        rate = mu * np.exp(sigma * z)
        first = (p * (y - rate)).sum()
        d1, d2 = kernels.poisson_lognormal_derivatives(np.array([float(y)]), np.array([mu]), sigma)
        assert d1[0] * mu == pytest.approx(first, abs=1e-6 * (1 + y))
        assert d2[0] * mu * mu == pytest.approx((p * ((y - rate) ** 2 - y)).sum() - first**2, abs=1e-4 * (1 + y))
