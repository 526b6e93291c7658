"""Low rank over distributed rows: against one matrix in numpy, a planted rank, other rows, groups, blocks of places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.ranks import ranked
from lacuna.operators import lowrank, rowwise
from lacuna.storage import Scratch

N = None
COLS = ["a", "b", "c", "d", "e"]


def planted(n, seed=0, noise=0.0, rank=2):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=(n, rank)) @ np.random.default_rng(9).normal(size=(rank, 5)) + noise * rng.normal(size=(n, 5))
    x = truth.copy()
    x[rng.random(x.shape) < 0.1] = np.nan
    return truth, x


def frame(spark, groups):
    rows = [(i + 1000 * k, g, *[N if np.isnan(v) else float(v) for v in r], "own") for k, (g, x) in enumerate(groups.items()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "i long, grp string, a double, b double, c double, d double, e double, m string")


def filled(imputer, df, model=None):
    return np.array([[r[c] for c in COLS] for r in (model or imputer.fit(df)).transform(df).orderBy("i").collect()])


def test_pursuit_equals_one_matrix(spark):
    """Without groups, and with a NULL group beside a larger one: the same optimum as the numpy class on each matrix."""
    groups = {"big": planted(120)[1], N: planted(40, 1)[1]}
    groups["big"][3, 0] += 40  # an anomaly
    df = frame(spark, groups)
    got = filled(lowrank.ImputerRpcaPcp(groups=["grp"], columns=COLS, max_iterations=60), df)
    at = 0
    for x in groups.values():
        centre, spread = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
        z = (x - centre) / spread
        one = lowrank.RpcaPcp(max_iterations=5_000, tolerance=1e-8).decompose(z, ~np.isnan(z))[0] * spread + centre
        mine = got[at : at + len(x)]
        hole = np.isnan(x)
        assert mine[~hole] == pytest.approx(x[~hole])
        assert mine[hole] == pytest.approx(one[hole], abs=5e-2)
        at += len(x)


@pytest.mark.parametrize("lam", [0.3, float("inf")])
def test_rows_on_a_basis_reach_the_minimum(lam):
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(2, 5)), rng.normal(size=(30, 5)) * 3
    x[rng.random(x.shape) < 0.2] = np.nan
    l, a = rowwise.on_basis(x, q, 0.2, lam)
    cost = lambda l, a: 0.5 * np.nansum((x - l @ q - a) ** 2) + 0.1 * (l**2).sum() + (lam * np.abs(a).sum() if np.isfinite(lam) else 0)
    best = cost(l, a)
    for _ in range(200):
        assert cost(l + 0.01 * rng.normal(size=l.shape), a + (0.01 * rng.normal(size=a.shape) * ~np.isnan(x) if np.isfinite(lam) else 0)) >= best - 1e-9


@pytest.mark.parametrize("make", [lowrank.ImputerRpcaNoisy, lowrank.ImputerSoftImpute])
def test_planted_rank_and_other_rows(spark, make):
    truth, x = planted(300)
    kw = {"rank": 2, "tau": 1e-3, "columns": COLS, "max_iterations": 40, "tolerance": 1e-7} | ({"lam": 5.0} if make is lowrank.ImputerRpcaNoisy else {})
    model = make(**kw).fit(frame(spark, {"g": x}))
    spread = truth.std()
    for seed in (0, 7):  # the rows of the fit, and others that the basis has not seen
        truth, x = planted(300 if seed == 0 else 25, seed)
        got, hole = filled(None, frame(spark, {"g": x}), model), np.isnan(x)
        # The means of what is known are not quite those of all: that is what is left of the error.
        assert got[~hole] == pytest.approx(x[~hole]) and np.sqrt(((got - truth)[hole] ** 2).mean()) < 0.05 * spread


def test_noisy_basis_beats_or_equals_one_matrix(spark):
    """The distributed fit's cost is no higher than that of the numpy block descent on the same matrix."""
    _, x = planted(150, 3, noise=0.3)
    x = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0)
    known = ~np.isnan(x)
    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "gid long, i long, x array<double>").repartition(5)
    tau, lam = 0.5, 0.4
    p = np.array(rowwise.fit_basis(rows, 5, 1, 2, tau, lam, 40, 1e-6, Scratch(spark)).first()["p"])
    q, _, _ = rowwise.basis_of(p, 5)
    l, a = rowwise.on_basis(x, q, tau, lam)
    cost = lambda m, a, pen: 0.5 * (np.where(known, x - m - a, 0) ** 2).sum() + pen + lam * np.abs(np.where(known, a, 0)).sum()
    mine = cost(l @ q, a, tau / 2 * ((l**2).sum() + (q**2).sum()))
    m, b, _ = lowrank.RpcaNoisy(rank=2, tau=tau, lam=lam, max_iterations=3000, tolerance=1e-10).decompose(x, known)
    theirs = cost(m, b, tau * np.linalg.svd(m, compute_uv=False).sum())
    assert mine <= theirs * 1.001
    # The factors balance, so the penalty is the nuclear norm.
    assert tau / 2 * ((l**2).sum() + (q**2).sum()) == pytest.approx(tau * np.linalg.svd(l @ q, compute_uv=False).sum(), rel=0.02)


def test_many_groups_are_joined_not_collected(spark, monkeypatch):
    groups = {"x": planted(60)[1], "y": planted(60, 2)[1] + 50}
    df = frame(spark, groups)
    a = filled(lowrank.ImputerSoftImpute(rank=2, groups=["grp"], columns=COLS, max_iterations=6), df)
    monkeypatch.setattr(rowwise, "SMALL", 0)
    b = filled(lowrank.ImputerSoftImpute(rank=2, groups=["grp"], columns=COLS, max_iterations=6), df.repartition(3))
    assert a == pytest.approx(b)


def test_folded_series(spark):
    """A seasonal series with holes, a last row that is not full, and order columns that hold ties of NULL groups."""
    n = 83
    season = np.array([3.0, -1, 4, 1, -5, 9, 2])
    df = spark.range(n).select(F.col("id").alias("t"), F.lit(None).cast("string").alias("grp"), F.expr(f"element_at(array({', '.join(map(str, season))}), cast(id % 7 as int) + 1) * (1 + floor(id / 7))").cast("double").alias("truth"))
    df = df.withColumn("x", F.when(F.col("t") * 31 % 10 > 0, F.col("truth")))
    keyed = {"period": 7, "order_by": ["t"], "columns": ["x"]}
    # Pursuit on a matrix this small takes some of the known cells for anomalies.
    for imputer, most in ((lowrank.ImputerRpcaPcp(groups=["grp"], max_iterations=30, **keyed), 20.0), (lowrank.ImputerSoftImpute(rank=2, tau=1e-6, **keyed), 0.1)):
        out = imputer.fit_transform(df.repartition(4)).toPandas()
        assert len(out) == n and (out["x"] - out["truth"]).abs().max() < most


def test_ranked_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "b").alias("g"))
    got = ranked(df, "g", "o", Scratch(spark), parts=9).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("o")["i"].tolist() == list(range(len(part)))


def test_empty_and_missing(spark):
    x = planted(30)[1]
    df = frame(spark, {"g": x, "none": np.full((3, 5), np.nan)})
    imputer = lowrank.ImputerRpcaNoisy(rank=1, groups=["grp"], columns=COLS, max_iterations=3)
    model = imputer.fit(df)
    assert not np.isnan(filled(None, df, model)).any()  # a group without values takes the table's medians
    assert model.transform(df.limit(0)).count() == 0
    assert model.transform(df.where("grp = 'g'").withColumn("grp", F.lit("new"))).where("a IS NULL").count() == 0
