"""Autoregressive smoothing in blocks: against a dense solve, cuts that change nothing, draws with the right law, groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import em, varblocks as vb

N = None


def model(d, lags, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(d, d))
    return rng.normal(size=(1 + lags * d, d)) * 0.3, a @ a.T + np.eye(d)


def series(n, b, s, seed=0):
    rng = np.random.default_rng(seed)
    lags, d = (len(b) - 1) // len(s), len(s)
    x = np.zeros((n, d))
    for t in range(lags, n):
        x[t] = b[0] + sum(x[t - k] @ b[1 + (k - 1) * d : 1 + k * d] for k in range(1, lags + 1)) + rng.multivariate_normal(np.zeros(d), s)
    return x


def dense(y, b, s, start=0):
    """Mean and covariance of the unknown cells given the others, row by row from the definition."""
    (n, d), inv = y.shape, np.linalg.inv(s)
    lags = (len(b) - 1) // d
    h, g = np.zeros((n * d, n * d)), np.zeros(n * d)
    for t in range(lags, n):
        e = np.zeros((d, n * d))
        e[:, t * d : (t + 1) * d] = np.eye(d)
        for k in range(1, lags + 1):
            e[:, (t - k) * d : (t - k + 1) * d] = -b[1 + (k - 1) * d : 1 + k * d].T
        h += e.T @ inv @ e
        g += e.T @ inv @ b[0]
    free = np.flatnonzero((np.isnan(y) & (np.arange(n) >= start)[:, None]).ravel())
    for f in free[free // d < lags]:
        h[f, f] += vb.WEAK / s[f % d, f % d]
    known = np.nan_to_num(y).ravel()
    cov = np.linalg.inv(h[np.ix_(free, free)])
    out = known.copy()
    out[free] = cov @ (g[free] - (h @ np.where(np.isin(np.arange(n * d), free), 0, known))[free])
    return out.reshape(n, d), free, cov


def cut(y, z, b, s, lags, length, start=0):
    n = len(y)
    count = -(-n // length)
    at = [max(0, q * length - (lags if q else 0)) for q in range(count)]
    return [vb.Block(y[a : (q + 1) * length], z[a : (q + 1) * length], a, start, lags if q else 0, q == count - 1, b, s, lags) for q, a in enumerate(at)]


CASES = [(2, 1, 40, 7), (2, 2, 37, 6), (3, 1, 31, 30), (1, 2, 23, 5), (2, 1, 22, 21)]


@pytest.mark.parametrize("d,lags,n,length", CASES)
def test_blocks_equal_a_dense_solve(d, lags, n, length):
    b, s = model(d, lags)
    y = series(n, b, s)
    y[np.random.default_rng(1).random(y.shape) < 0.4] = np.nan
    y[length - 1] = np.nan  # a border row that is missing altogether
    y[-1] = np.nan
    mean, free, cov = dense(y, b, s)
    blocks = cut(y, np.nan_to_num(y), b, s, lags, length)
    value, covs = vb.chain([k.form() for k in blocks])
    assert np.concatenate([k.given(v)[k.halo :] for k, v in zip(blocks, value)]) == pytest.approx(mean, abs=1e-6)
    # Second moments of windows, from the dense covariance.
    full = np.zeros((n * d, n * d))
    full[np.ix_(free, free)] = cov
    full += np.outer(mean.ravel(), mean.ravel())
    expected = np.zeros((1 + (lags + 1) * d,) * 2)
    for t in range(lags, n):
        cells = np.concatenate([np.arange((t - k) * d, (t - k + 1) * d) for k in range(lags + 1)])
        expected[0, 0] += 1
        expected[0, 1:] += mean.ravel()[cells]
        expected[1:, 0] += mean.ravel()[cells]
        expected[1:, 1:] += full[np.ix_(cells, cells)]
    got = sum(k.moments(k.given(v), c) for k, v, c in zip(blocks, value, covs))
    assert got == pytest.approx(expected, rel=1e-6, abs=1e-6)


def test_draws_have_the_law():
    b, s = model(2, 1)
    y = series(24, b, s)
    y[np.random.default_rng(2).random(y.shape) < 0.4] = np.nan
    y[0] = 0
    mean, free, cov = dense(y, b, s)
    blocks = cut(y, np.nan_to_num(y), b, s, 1, 5)
    forms, rng, many = [k.form() for k in blocks], np.random.default_rng(3), 6000
    drawn = np.empty((many, len(free)))
    for i in range(many):
        value, _ = vb.chain(forms, [rng.standard_normal(2) for _ in blocks])
        drawn[i] = np.concatenate([k.given(v, rng)[k.halo :] for k, v in zip(blocks, value)]).ravel()[free]
    assert np.abs(drawn.mean(axis=0) - mean.ravel()[free]).max() < 5 * np.sqrt(np.diag(cov).max() / many)
    assert np.abs(np.cov(drawn.T) - cov).max() < 0.12 * np.diag(cov).max()


def frame(spark, groups):
    rows = [(i + 1000 * k, g, *[N if np.isnan(v) else float(v) for v in r], "own") for k, (g, x) in enumerate(groups.items()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "t long, grp string, a double, b double, m string")


KW = {"model": "VAR", "p": 1, "order_by": ["t"], "columns": ["a", "b"]}


@pytest.fixture(scope="module")
def groups():
    b, s = np.array([[0.5, -0.2], [0.8, 0.1], [-0.1, 0.7]]), np.array([[1.0, 0.3], [0.3, 0.5]])
    out = {}
    for g, n, seed in (("hot", 300, 0), (N, 60, 1)):
        out[g] = series(n, b, s, seed)
        out[g][np.random.default_rng(seed).random(out[g].shape) < 0.2] = np.nan
        out[g][1] = [0.1, -0.1]
    return out


def values(out):
    return {r["t"]: (r["a"], r["b"]) for r in out.select("t", "a", "b").collect()}


def test_groups_blocks_and_partitions_change_nothing(spark, groups):
    df = frame(spark, groups)
    a = values(em.ImputerEM(groups=["grp"], max_iter_em=3, **KW).fit_transform(df))
    b = values(em.ImputerEM(groups=["grp"], max_iter_em=3, block=11, **KW).fit_transform(df.repartition(7)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)
    # Plain numpy EM on each series.
    for k, y in enumerate(groups.values()):
        z = y.copy()
        for j in range(2):
            ok = ~np.isnan(y[:, j])
            z[:, j] = np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok, j])
        start = int((~np.isnan(y).any(axis=1)).argmax())
        whole = vb.Block(y, z, 0, start, 0, True, np.zeros((3, 2)), np.eye(2), 1)
        p = vb.solve_moments(whole.moments(whole.value, None), 2, 1)
        for _ in range(3):
            whole = vb.Block(y, z, 0, start, 0, True, *p, 1)
            p = vb.solve_moments(whole.moments(whole.given(np.zeros(4)), np.zeros((4, 4))), 2, 1)
        mean = vb.Block(y, z, 0, start, 0, True, *p, 1).given(np.zeros(4))
        assert np.array([a[i + 1000 * k] for i in range(len(y))]) == pytest.approx(mean, abs=1e-7)


def test_draws_differ_by_seed_only(spark, groups):
    df = frame(spark, groups)
    make = lambda seed: em.ImputerEM(groups=["grp"], method="sample", seed=seed, max_iter_em=2, **KW)
    mean = values(em.ImputerEM(groups=["grp"], max_iter_em=2, **KW).fit_transform(df))
    a, again, other = values(make(1).fit_transform(df)), values(make(1).fit_transform(df.repartition(5))), values(make(2).fit_transform(df))
    assert all(a[k] == pytest.approx(again[k], abs=1e-7) for k in a)
    holes = [k for k in a if a[k] != pytest.approx(mean[k], abs=1e-9)]
    assert len(holes) == len([k for k in a if a[k] != other[k]]) == df.where("t NOT IN (0, 1000) AND (a IS NULL OR b IS NULL)").count()
    gap = np.array([np.subtract(a[k], mean[k]) for k in holes])
    assert 0.3 < np.sqrt((gap[gap != 0] ** 2).mean()) < 1.5


def test_lag_by_aic_other_tables_and_odd_groups(spark, groups):
    df = frame(spark, groups | {"short": np.array([[1.0, N], [2, 3]], float), "none": np.full((9, 2), np.nan)})
    model = em.ImputerEM(groups=["grp"], max_iter_em=1, **(KW | {"p": None})).fit(df)
    assert model.transform(df).where("a IS NULL OR b IS NULL").count() == 0
    assert model.transform(df.limit(0)).count() == 0
    assert model.transform(df.where("grp = 'hot'").withColumn("grp", F.lit("new"))).where("a IS NULL").count() == 0


def test_folded(spark, groups):
    out = em.ImputerEM(period=2, max_iter_em=1, **KW).fit_transform(frame(spark, {"x": groups["hot"][:61]}))
    assert out.count() == 61 and out.where("a IS NULL OR b IS NULL").count() == 0
