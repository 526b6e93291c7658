"""More columns than a long has bits, and columns far from zero."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.frame import Spec, bit_set, pattern
from lacuna.operators import em, holes, mcar, metrics, neural, regress


def table(spark, x):
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])]).assign(id=np.arange(len(x)))
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def sample(d, n=300, rate=0.05, mean=0.0):
    rng = np.random.default_rng(d)
    f = rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)) + 0.3 * rng.normal(size=(n, d)) + mean
    x = f.copy()
    x[rng.random((n, d)) < rate] = np.nan
    return x


def little(x, rounds, tol):
    """Little's statistic and degrees of freedom row by row in numpy."""
    n, d = x.shape
    mu, hole = np.nanmean(x, axis=0), np.isnan(x)
    sigma = np.diag(np.nanmean((x - mu) ** 2, axis=0))
    for it in range(1, rounds + 1):
        y, c = np.where(hole, 0, x), np.zeros((d, d))
        for r in range(n):
            h, o = np.flatnonzero(hole[r]), np.flatnonzero(~hole[r])
            w = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)], rcond=1e-12)
            y[r, h] = mu[h] + w @ (x[r, o] - mu[o])
            c[np.ix_(h, h)] += sigma[np.ix_(h, h)] - w @ sigma[np.ix_(o, h)]
        new = y.mean(axis=0)
        moved = max(np.abs(new - mu).max(), np.abs((z := (y - new).T @ (y - new) / n + c / n) - sigma).max())
        mu, sigma = new, z
        if moved < tol and it >= 3:
            break
    s, d2, free = sigma * n / (n - 1), 0.0, 0
    for p in np.unique(hole, axis=0):
        o, at = np.flatnonzero(~p), np.flatnonzero((hole == p).all(axis=1))
        gap = x[np.ix_(at, o)].mean(axis=0) - mu[o]
        d2, free = d2 + len(at) * gap @ np.linalg.pinv(s[np.ix_(o, o)]) @ gap, free + len(o)
    return d2, free - d


@pytest.mark.parametrize("d,mean", [(82, 0.0), (4, 1e9)])
def test_little_equals_rows_in_numpy(spark, d, mean):
    x = sample(d, mean=mean)
    got = mcar.LittleTest([f"c{i}" for i in range(d)], max_iter=4, tolerance=1e-8).statistic(table(spark, x))
    want = little(x - mean, 4, 1e-8)
    assert got[1] == want[1] and got[0] == pytest.approx(want[0], rel=1e-5)


def test_em_fills_100_columns(spark):
    x = sample(100, n=200)
    cols = [f"c{i}" for i in range(100)]
    got = em.ImputerEM(key=["id"], columns=cols, max_iter_em=4).fit_transform(table(spark, x)).toPandas().sort_values("id")[cols].to_numpy(float)
    seen = ~np.isnan(x)
    assert np.isfinite(got).all() and np.array_equal(got[seen], x[seen])
    truth = sample(100, n=200, rate=0.0)
    mean = np.abs(np.nanmean(x, axis=0) - truth)[~seen].mean()
    assert np.abs(got - truth)[~seen].mean() < 0.5 * mean


def test_passes_equal_pattern_moments(spark, monkeypatch):
    x = sample(4, n=200, rate=0.2, mean=1e6)
    df, cols = table(spark, x), [f"c{i}" for i in range(4)]
    fill = lambda: em.ImputerEM(key=["id"], columns=cols, max_iter_em=15).fit_transform(df).toPandas().sort_values("id")[cols].to_numpy(float)
    a = fill()
    monkeypatch.setattr(em, "WIDE", 2)
    assert np.allclose(a, fill(), rtol=0, atol=1e-5)


def test_wide_patterns(spark):
    x = sample(70, n=60)
    df, cols = table(spark, x), [f"c{i}" for i in range(70)]
    keys = {r["id"]: r["p"] for r in df.select("id", pattern(cols).alias("p")).collect()}
    assert all([bit_set(keys[r], i) for i in range(70)] == list(np.isnan(x[r])) for r in range(60))
    steps = holes.transition_counts(df, cols, Spec.of(["id"]))
    assert steps.agg(F.sum("n")).first()[0] == 61
    scored = df.fillna(0.0).withColumns({f"c{i}_imputed": F.col(f"c{i}") for i in range(70)} | {f"m_c{i}": F.lit(i == 66) for i in range(70)})
    assert metrics.dist_corr_pattern(scored, cols) == pytest.approx(0.0, abs=1e-9)


def test_regression_far_from_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1]
    full = np.column_stack([x, y]) + 1e9
    z = full.copy()
    z[::9, 2] = np.nan
    got = regress.ImputerRegressor(key=["id"], columns=["c0", "c1", "c2"]).fit_transform(table(spark, z)).toPandas().sort_values("id")["c2"].to_numpy()
    assert np.abs(got - full[:, 2]).max() < 1e-4


def test_diffusion_without_noise_is_finite():
    z = np.random.default_rng(0).normal(size=(60, 2))
    z[::5, 1] = np.nan
    for most in (0.0, 0.02):
        out = neural.ImputerDiffusion(epochs=2, num_noise_steps=3, beta_start=0.0, beta_end=most, num_sampling=1, key=["i"], order_by=["i"]).impute(z, np.random.default_rng(1), None)
        assert np.isfinite(out).all()
