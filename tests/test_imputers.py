"""Imputers on small frames with known results, and the contract that all of them keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.errors import AllMissingColumn, LacunaError, OrderRequired, SchemaChanged, TypeNotHandled
from lacuna.operators import em, knn, lowrank, neural, regress, simple

N = None
KW = {"order_by": ["i"], "key": ["i"]}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(0, 0.0, -1.0), (1, N, N), (2, 2.0, 0.5), (3, 3.0, N), (4, N, 1.5)], "i int, col1 double, col2 double")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(0, 0.0, "a"), (1, N, N), (2, 2.0, "b"), (3, 3.0, N), (4, N, "b")], "i int, col1 double, col2 string")


def values(imputer, df):
    rows = imputer.fit_transform(df).orderBy("i").collect()
    return [r["col1"] for r in rows], [r["col2"] for r in rows]


GOLDEN = [
    (simple.ImputerLOCF(**KW), [0, 0, 2, 3, 3], [-1, -1, 0.5, 0.5, 1.5]),
    (simple.ImputerLOCF(n_blocks=3, **KW), [0, 0, 2, 3, 3], [-1, -1, 0.5, 0.5, 1.5]),
    (simple.ImputerNOCB(**KW), [0, 2, 2, 3, 3], [-1, 0.5, 0.5, 1.5, 1.5]),
    (simple.ImputerNOCB(n_blocks=3, **KW), [0, 2, 2, 3, 3], [-1, 0.5, 0.5, 1.5, 1.5]),
    (simple.ImputerInterpolation(**KW), [0, 1, 2, 3, 3], [-1, -0.25, 0.5, 1, 1.5]),
    (knn.ImputerKNN(n_neighbors=2, **KW), [0, 5 / 3, 2, 3, 10 / 7], [-1, 1 / 3, 0.5, 1 / 8, 1.5]),
    (simple.ImputerSimple(strategy="mean", **KW), [0, 5 / 3, 2, 3, 5 / 3], [-1, 1 / 3, 0.5, 1 / 3, 1.5]),
]


@pytest.mark.parametrize("imputer,col1,col2", GOLDEN)
def test_golden(frame, imputer, col1, col2):
    a, b = values(imputer, frame)
    assert a == pytest.approx(col1) and b == pytest.approx(col2)


@pytest.mark.parametrize("strategy,col1", [("mean", [0, 5 / 3, 2, 3, 5 / 3]), ("median", [0, 2, 2, 3, 2]), ("most_frequent", [0, 0, 2, 3, 0])])
def test_mixed(mixed, strategy, col1):
    a, b = values(simple.ImputerSimple(strategy=strategy, **KW), mixed)
    assert a == pytest.approx(col1) and b == list("abbbb")


def test_residuals(spark):
    df = spark.createDataFrame([(i, float(i), {1: N, 3: N, 4: 2.0}.get(i, float(i))) for i in range(20)], "i int, col1 double, col2 double")
    a, b = values(simple.ImputerResiduals(period=7, **KW), df)
    assert a == list(range(20))
    assert b[:5] == pytest.approx([0, 0.953, 2, 2.061, 2], abs=1e-3) and b[5:] == list(range(5, 20))


def test_oracle(frame, spark):
    truth = spark.createDataFrame([(i, float(i), float(-i)) for i in range(5)], "i int, col1 double, col2 double")
    assert values(simple.ImputerOracle(truth, **KW), frame) == ([0, 1, 2, 3, 4], [-1, -1, 0.5, -3, 1.5])
    assert values(simple.ImputerOracle(**KW), frame)[0] == [0, 0, 2, 3, 0]


def _everything():
    kw = KW | {"groups": ["g"], "columns": ["x", "y"]}
    return [
        simple.ImputerSimple(strategy="mean", **kw), simple.ImputerSimple(**kw), simple.ImputerShuffle(**kw), simple.ImputerLOCF(**kw), simple.ImputerNOCB(**kw), simple.ImputerInterpolation(**kw),
        simple.ImputerInterpolation(method="cubic", **kw), simple.ImputerResiduals(period=3, **kw), knn.ImputerKNN(**kw), regress.ImputerMICE(max_iter=5, **kw), regress.ImputerRegressor(**kw),
        regress.ImputerRegressor(estimator="bayes", **kw), regress.ImputerRegressor(estimator="trees", **kw), em.ImputerEM(**kw), em.ImputerEM(method="sample", **kw), em.ImputerEM(model="VAR", p=1, **kw),
        lowrank.ImputerRpcaPcp(period=2, **kw), lowrank.ImputerRpcaNoisy(rank=1, **kw), lowrank.ImputerSoftImpute(rank=1, **kw), neural.ImputerRegressorMLP(epochs=20, **kw),
        neural.ImputerAutoencoder(max_iterations=2, epochs=10, **kw), neural.ImputerDiffusion(epochs=10, num_noise_steps=5, num_sampling=1, **kw), neural.ImputerDiffusion(model="TsDDPM", epochs=10, num_noise_steps=5, num_sampling=1, **kw),
    ]


@pytest.fixture(scope="module")
def two_groups(spark):
    """Two groups around 0 and 100 with holes in both: a model of one group does not do for the other."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        base = 100.0 * (i % 2)
        x = base + float(rng.normal())
        rows.append((i, "ab"[i % 2], x, N if i % 9 in (3, 4) else x + float(rng.normal())))
    return spark.createDataFrame(rows, "i int, g string, x double, y double").cache()


@pytest.mark.parametrize("imputer", _everything(), ids=lambda m: type(m).__name__ + str(m.hyper.get("method", m.hyper.get("model", ""))))
def test_contract(two_groups, imputer):
    before = two_groups.orderBy("i").toPandas()
    after = imputer.fit_transform(two_groups).orderBy("i").toPandas()
    assert list(after.columns) == list(before.columns) and len(after) == len(before)
    assert after["y"].notna().all()
    seen = before["y"].notna()
    assert (after["y"][seen] == before["y"][seen]).all() and (after["x"] == before["x"]).all()
    gap = (after["y"] - 100 * (after["i"] % 2))[~seen].abs()
    assert gap.max() < 20


def test_fallback_ignores_groups(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", N), (2, "b", 100.0), (3, "b", 104.0), (4, "c", N)], "i int, g string, x double")
    got = {r["i"]: r["x"] for r in simple.ImputerSimple(groups=["g"], **KW).fit_transform(df).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 100.0, 3: 104.0, 4: 50.5}


def test_parameters_by_column(frame):
    imp = simple.ImputerSimple(**KW, **{"strategy": "mean", "strategy/col2": "median"})
    a, b = values(imp, frame)
    assert a[1] == pytest.approx(5 / 3) and b[1] == 0.5


def test_errors(spark, frame):
    with pytest.raises(AllMissingColumn):
        simple.ImputerSimple().fit(spark.createDataFrame([(N, 1), (N, 2)], "a double, b int"))
    with pytest.raises(OrderRequired):
        simple.ImputerLOCF().fit(frame)
    with pytest.raises(TypeNotHandled):
        simple.ImputerSimple().fit(spark.sql("select current_timestamp() as t"))
    with pytest.raises(SchemaChanged):
        simple.ImputerSimple(**KW).fit(frame).transform(frame.drop("col2"))
    with pytest.raises(LacunaError):
        simple.ImputerInterpolation(method="none", **KW).fit_transform(frame).collect()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0)], "i int, x double")
    assert [r["x"] for r in simple.ImputerSimple(strategy="mean", **KW).fit_transform(df).orderBy("i").collect()] == [1.0, 2.0, 3.0]


def test_fit_then_transform_other_rows(spark, frame):
    model = simple.ImputerSimple(strategy="mean", refit=False, **KW).fit(frame)
    other = spark.createDataFrame([(9, N, 7.0)], "i int, col1 double, col2 double")
    assert model.transform(other).first()["col1"] == pytest.approx(5 / 3)


def test_em_recovers_parameters():
    rng = np.random.default_rng(1)
    mu, sigma = np.array([5.0, -2.0]), np.array([[1, -0.5], [-0.5, 2]])
    x = rng.multivariate_normal(mu, sigma, 20_000)
    hole = rng.random(20_000) < 0.3
    rows = []
    for code, part in ((0, x[~hole]), (2, x[hole])):
        rows.append({"_p": code, "n": len(part), "s_0": part[:, 0].sum(), "s_1": part[:, 1].sum(), "q_0_0": (part[:, 0] ** 2).sum(), "q_0_1": (part[:, 0] * part[:, 1]).sum(), "q_1_1": (part[:, 1] ** 2).sum()})
    m, s, _ = em.gaussian_em(rows, 2)
    assert m == pytest.approx(mu, abs=0.05) and s == pytest.approx(sigma, abs=0.1)


def test_low_rank_costs_fall():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 12)) + 0.05 * rng.normal(size=(60, 12))
    known = rng.random(d.shape) > 0.1
    noisy = lowrank.RpcaNoisy(rank=2, list_periods=(3,), list_etas=(0.01,))
    m, a, q = noisy.decompose(d, known)
    _, tau, lam = noisy.resolved(d)
    assert noisy.cost(d, known, m, a, tau, lam) < noisy.cost(d, known, d, np.zeros_like(d), tau, lam)
    assert np.abs((m - d)[~known]).mean() < 0.6
    on, _ = noisy.decompose_on_basis(d, known, q)
    assert np.abs((on - d)[known]).mean() < 0.5
    soft, _ = lowrank.SoftImpute(rank=2).decompose(d, known)
    assert lowrank.SoftImpute.cost(d, known, soft, 0.1) <= lowrank.SoftImpute.cost(d, known, np.where(known, d, 0), 0.1)
    low, sparse = lowrank.RpcaPcp(lam=0.0).decompose(d, np.ones_like(known))
    assert low + sparse == pytest.approx(d, abs=1e-3)


def test_diffusion_epoch_walks_all_rows(monkeypatch):
    steps = []
    step = neural.Dense.step
    monkeypatch.setattr(neural.Dense, "step", lambda net, kept, g, rate: (steps.append(kept[0][:, :2].copy()), step(net, kept, g, rate))[1])
    z = np.random.default_rng(0).normal(size=(700, 2))
    z[::7, 1] = np.nan
    neural.ImputerDiffusion(epochs=3, num_noise_steps=4, num_sampling=1, **KW).impute(z, np.random.default_rng(1), None)
    assert [len(s) for s in steps] == [256, 256, 188] * 3
    # Without noise the network sees the rows themselves: each once an epoch.
    steps.clear()
    neural.ImputerDiffusion(epochs=2, num_noise_steps=1, beta_start=0.0, beta_end=0.0, num_sampling=1, **KW).impute(z, np.random.default_rng(1), None)
    for e in (0, 3):
        assert sorted(np.concatenate(steps[e : e + 3])[:, 0]) == pytest.approx(sorted(z[:, 0]))


@pytest.mark.parametrize("make", [simple.ImputerLOCF, simple.ImputerNOCB, simple.ImputerInterpolation, lambda **k: simple.ImputerInterpolation(method="time", col_time="t", **k)])
@pytest.mark.parametrize("groups", [["g"], []])
def test_blocks_inside_groups_change_nothing(spark, make, groups):
    """A hot group, a null group, a group without observations at its ends, and blocks that hold holes only."""
    i = F.col("id")
    g = F.when(i % 10 < 7, "hot").when(i % 10 < 9, "b")
    x = F.when((i * 7919 % 100 >= 40) & ~i.between(200, 330) & (i > 12), (i * 31 % 97).cast("double"))
    df = spark.range(600).select(i, (i * i).cast("timestamp").alias("t"), g.alias("g"), x.alias("x"))
    keyed = {"groups": groups, "order_by": ["id"], "key": ["id"], "columns": ["x"]}
    plain, cut = ({r["id"]: r["x"] for r in make(**keyed, n_blocks=n).fit_transform(df).collect()} for n in (1, 7))
    assert plain.keys() == cut.keys() and all(abs(plain[k] - cut[k]) < 1e-9 for k in plain)
