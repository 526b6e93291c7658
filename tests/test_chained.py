"""Chained equations for all groups at once: against plain numpy, draws against their closed form, skewed and odd groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.errors import EstimatorNotDefined, LacunaError
from lacuna.operators import chained, regress

N = None


def plain(x, most, ridge=0.0):
    hole = np.isnan(x)
    z = np.where(hole, np.nanmean(x, axis=0), x)
    for _ in range(most):
        for j in sorted((j for j in range(x.shape[1]) if hole[:, j].any()), key=lambda j: hole[:, j].sum()):
            a = np.concatenate([np.ones((len(z), 1)), np.delete(z, j, axis=1)], axis=1)
            s = ~hole[:, j]
            c = np.linalg.solve(a[s].T @ a[s] + np.diag([0.0] + [ridge] * (a.shape[1] - 1)), a[s].T @ z[s, j])
            z[~s, j] = a[~s] @ c
    return z


def blocks(seed=0):
    """A hot group, one far from zero, a NULL one."""
    rng = np.random.default_rng(seed)
    out = {}
    for g, n, at in (("hot", 300, 0.0), ("far", 60, 1e6), (N, 40, -5.0)):
        u = rng.normal(size=n)
        x = np.stack([u, 2 * u + rng.normal(size=n), u - rng.normal(size=n)], axis=1) + at
        x[rng.random(x.shape) < 0.15] = np.nan
        x[0] = at
        out[g] = x
    return out


def frame(spark, groups):
    # User columns bear the names that the operator uses inside.
    rows = [(i + 1000 * k, g, *[N if np.isnan(v) else float(v) for v in r], "kept", 7.5) for k, (g, x) in enumerate(groups.items()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, g string, x double, y double, z double, row string, coef double")


@pytest.mark.parametrize("kind,ridge,small", [("ols", 0.0, chained.SMALL), ("ridge", 1.0, 0)])
def test_groups_equal_plain_runs(spark, monkeypatch, kind, ridge, small):
    """Coefficients that pass through the driver and stored ones."""
    monkeypatch.setattr(chained, "SMALL", small)
    groups = blocks()
    imputer = regress.ImputerMICE(estimator=kind, max_iter=3, tolerance=0.0, groups=["g"], key=["id"], columns=["x", "y", "z"])
    df = frame(spark, groups)
    got = {r["id"]: r for r in imputer.fit_transform(df).collect()}
    assert len(got) == 400 and {(r["row"], r["coef"]) for r in got.values()} == {("kept", 7.5)}
    for k, x in enumerate(groups.values()):
        order = np.isnan(np.concatenate(list(groups.values()))).sum(axis=0)
        assert len(set(order)) == 3  # the order of columns is that of the whole table
        centre = np.nanmean(x, axis=0)
        hole = np.isnan(x)
        z = np.where(hole, 0, x - centre)
        for _ in range(3):
            for j in np.argsort(order):
                a = np.concatenate([np.ones((len(z), 1)), np.delete(z, j, axis=1)], axis=1)
                s = ~hole[:, j]
                z[~s, j] = a[~s] @ np.linalg.solve(a[s].T @ a[s] + np.diag([0.0, ridge, ridge]), a[s].T @ z[s, j])
        mine = np.array([[got[i + 1000 * k][c] for c in "xyz"] for i in range(len(x))])
        assert mine == pytest.approx(z + centre, rel=1e-9, abs=1e-6)


def test_without_groups_equals_plain(spark):
    x = blocks(1)["hot"]
    got = regress.ImputerMICE(estimator="ols", max_iter=3, tolerance=0.0, key=["id"], columns=["x", "y", "z"]).fit_transform(frame(spark, {"a": x})).orderBy("id").select("x", "y", "z").toPandas().to_numpy()
    assert got == pytest.approx(plain(x, 3), abs=1e-8)


def test_bayes_is_near_ols_with_many_rows(spark):
    x = blocks(2)["hot"]
    a, b = (regress.ImputerMICE(estimator=k, max_iter=3, key=["id"], columns=["x", "y", "z"]).fit_transform(frame(spark, {"a": x})).orderBy("id").select("x", "y", "z").toPandas().to_numpy() for k in ("ols", "bayes"))
    assert np.abs(a - b).max() < 0.1


def test_draws_have_the_posterior_moments():
    """Coefficients over many seeds: mean b, covariance s2 (X'X)^-1 times dof / (dof - 2)."""
    rng = np.random.default_rng(0)
    n, k = 60, 2
    x = rng.normal(size=(n, k)) + [3, -1]
    y = 1 + x @ [2, -1] + rng.normal(size=n)
    full = np.concatenate([np.ones((n, 1)), x, y[:, None]], axis=1)
    g = full.T @ full
    coef, cov, rss, dof = chained.posterior(g, 0.0, False)
    assert coef == pytest.approx(np.linalg.lstsq(full[:, :-1], y, rcond=None)[0]) and dof == n - k - 1
    import pyarrow as pa

    upper = np.triu_indices(k + 2)
    many = 4000
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * many), pa.array(range(many)), *[pa.array([v] * many) for v in g[upper]]], ["g", "hashed", *map(str, range(len(upper[0])))])
    out = next(chained.solver(k, 0.0, False, (1, 0, 0))(iter([batch]))).to_pandas()
    drawn = np.stack(out["coef"])
    law = rss / (dof - 2) * cov
    assert np.abs(drawn.mean(axis=0) - coef).max() < 5 * np.sqrt(np.diag(law).max() / many)
    assert np.cov(drawn.T) == pytest.approx(law, rel=0.15, abs=0.1 * np.diag(law).max())
    assert (out["sd"] ** 2).mean() == pytest.approx(rss / (dof - 2), rel=0.05)
    # The evidence form keeps the law where the prior hardly matters.
    b, c, r, _ = chained.posterior(g, 0.0, True)
    assert b == pytest.approx(coef, abs=0.1) and c == pytest.approx(cov, rel=0.2, abs=0.01) and r == pytest.approx(rss, rel=0.2)


def test_draws_by_row(spark):
    groups = blocks(3)
    make = lambda seed: regress.ImputerMICE(estimator="ols", max_iter=2, sample_posterior=True, seed=seed, groups=["g"], key=["id"], columns=["x", "y", "z"])
    df = frame(spark, groups)
    a, again, other = ({r["id"]: (r["x"], r["y"], r["z"]) for r in make(s).fit_transform(d).collect()} for s, d in ((1, df), (1, df.repartition(7)), (2, df)))
    assert a.keys() == again.keys() and all(a[k] == pytest.approx(again[k], rel=1e-9) for k in a)
    moved = sum(a[k] != other[k] for k in a)
    assert moved == df.where("x IS NULL OR y IS NULL OR z IS NULL").count()
    mean = {r["id"]: r["y"] for r in regress.ImputerMICE(estimator="ols", max_iter=4, groups=["g"], key=["id"], columns=["x", "y", "z"]).fit_transform(df).collect()}
    gap = np.array([a[r["id"]][1] - mean[r["id"]] for r in df.where("y IS NULL AND g = 'hot'").collect()])
    assert 0.7 < gap.std() < 1.5 and abs(gap.mean()) < 0.6


def test_odd_groups(spark):
    """No value in a group: the whole table's median. One row, constant columns, no holes, an empty table."""
    rows = [(i, "a", float(i), float(2 * i) if i % 3 else N) for i in range(12)] + [(20, "none", 1.0, N), (21, "one", N, 3.0), (22, "flat", 5.0, N), (23, "flat", 5.0, 4.0), (24, "flat", 5.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in regress.ImputerMICE(estimator="ols", max_iter=3, groups=["g"], key=["id"], columns=["x", "y"]).fit_transform(df).collect()}
    assert all(got[i][1] == pytest.approx(2 * i) for i in range(12)) and got[22] == (5.0, pytest.approx(4.0))
    assert got[20][1] is not None and got[21][0] is not None
    model = regress.ImputerMICE(estimator="ols", max_iter=3, groups=["g"], key=["id"], columns=["x", "y"]).fit(df)
    assert model.transform(df.limit(0)).count() == 0
    whole = df.where("id < 12 AND y IS NOT NULL")
    assert sorted(map(tuple, regress.ImputerMICE(max_iter=2, key=["id"], columns=["x", "y"]).fit_transform(whole).collect())) == sorted(map(tuple, whole.collect()))


def test_no_group_is_gathered(spark):
    df = frame(spark, blocks())
    plan = regress.ImputerMICE(estimator="ols", max_iter=2, groups=["g"], key=["id"], columns=["x", "y", "z"]).fit_transform(df)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


def test_draws_ask_for_keys_and_a_posterior(spark):
    df = frame(spark, blocks())
    with pytest.raises(LacunaError):
        regress.ImputerMICE(sample_posterior=True, columns=["x", "y"]).fit(df)
    with pytest.raises(EstimatorNotDefined):
        regress.ImputerMICE(sample_posterior=True, estimator="trees", key=["id"], columns=["x", "y"]).fit(df)
