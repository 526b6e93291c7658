"""Splines: linear-time solves against dense ones, and known curves."""

import time

import numpy as np
import pytest

from lacuna.operators.simple import basis, solve_band, spline


def dense(knots, k, n, t):
    out = np.zeros((len(t), n))
    first, v = basis(knots, k, n, t)
    for i, (f, row) in enumerate(zip(first, v)):
        out[i, f : f + k + 1] = row
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("n", [7, 16, 33, 200])
def test_band_equals_dense(n, k):
    rng = np.random.default_rng(n)
    x, y = np.sort(rng.random(n)), rng.normal(size=n)
    inner = np.array([x[i : i + k].mean() for i in range(1, n - k)])
    knots = np.r_[np.full(k + 1, x[0]), inner, np.full(k + 1, x[-1])]
    a = dense(knots, k, n, x)
    assert a.sum(axis=1) == pytest.approx(np.ones(n))
    c = np.linalg.solve(a, y)
    assert solve_band(*basis(knots, k, n, x), y) == pytest.approx(c, rel=1e-6, abs=1e-6 * abs(c).max())
    at = np.linspace(x[0], x[-1], 50)
    assert spline(x, y, at, k) == pytest.approx(dense(knots, k, n, at) @ c, rel=1e-6, abs=1e-6 * abs(c).max())
    assert spline(x, y, x, k) == pytest.approx(y, abs=1e-6 * abs(c).max())


@pytest.mark.parametrize("k", [1, 2, 3])
def test_gives_polynomials_back(k):
    rng = np.random.default_rng(1)
    x = np.sort(rng.choice(10_000, 600, replace=False)) + 1.7e9  # as epoch seconds
    f = lambda t: ((t - 1.7e9) / 5000 - 1) ** k + 3
    at = np.linspace(x[0], x[-1], 999)
    assert spline(x, f(x), at, k) == pytest.approx(f(at), rel=1e-6)


def test_odd():
    assert np.isnan(spline(np.zeros(0), np.zeros(0), np.ones(2), 3)).all()
    assert spline(np.ones(1), np.full(1, 4.0), np.array([0.0, 9.0]), 3).tolist() == [4, 4]
    assert spline(np.array([0.0, 0, 2]), np.array([1.0, 3, 6]), np.array([-5.0, 0, 1, 2, 7]), 3) == pytest.approx([2, 2, 4, 6, 6])
    assert spline(np.array([2.0, 0, 1]), np.array([4.0, 0, 1]), np.array([1.5]), 2) == pytest.approx([2.25])


def test_linear_in_rows():
    x = np.arange(200_000.0)
    t = time.time()
    got = spline(x, np.sin(x / 50), x[:-1] + 0.5, 3)
    assert abs(got - np.sin((x[:-1] + 0.5) / 50)).max() < 1e-6 and time.time() - t < 30
