"""Metrics, holes, tests of missingness, preprocessing, selection, sources, streaming."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.errors import LacunaError, NotEnoughSamples, SubsetIsAString, UnknownDataset
from lacuna.frame import Spec
from lacuna.functions import linalg, special
from lacuna.operators import holes, mcar, metrics, preprocessing, simple
from lacuna.plans.comparator import Comparator, rank_imputers
from lacuna.plans.search import minimize, optimize, refilled
from lacuna.sources import datasets, tsf
from lacuna.streaming.carry import stream_locf

N = None


@pytest.fixture(scope="module")
def scored(spark):
    truth = [(0.0, -1.0), (N, N), (2.0, 0.5), (3.0, 1.0), (N, 1.5)]
    made = [(0.0, -1.5), (1.0, 0.0), (2.0, 1.5), (3.5, 2.0), (4.0, 1.5)]
    mask = [(False, True), (False, False), (True, True), (True, True), (False, False)]
    return spark.createDataFrame([(*a, *b, *c) for a, b, c in zip(truth, made, mask)], "a double, b double, a_imputed double, b_imputed double, m_a boolean, m_b boolean")


GOLDEN = {"mse": (0.125, 0.75), "rmse": (0.354, 0.866), "mae": (0.25, 0.833), "mape": (0.083, 1.166), "wmape": (0.1, 1.0), "accuracy": (0.5, 0.0), "wasserstein_columnwise": (0.25, 0.833), "ks_test": (0.5, 2 / 3), "kl_columnwise": (18.945, 36.637)}


@pytest.mark.parametrize("name", GOLDEN)
def test_metric_golden(scored, name):
    got = metrics.get_metric(name)(scored, ["a", "b"])
    assert (got["a"], got["b"]) == pytest.approx(GOLDEN[name], abs=2e-3)


def test_total_variation(spark):
    rows = [("a", "c", "a", "b", True, True), (N, N, "b", "d", False, False), ("a", "d", "a", "c", True, True), ("b", "b", "c", "d", True, True), (N, "d", "c", "d", False, False)]
    df = spark.createDataFrame(rows, "a string, b string, a_imputed string, b_imputed string, m_a boolean, m_b boolean")
    assert metrics.total_variation(df, "a").first()["value"] == pytest.approx(2 / 3)
    with pytest.raises(LacunaError):
        metrics.get_metric("none")


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 1
    df = spark.createDataFrame([(*map(float, a), *map(float, b), True, True) for a, b in zip(x, y)], "a double, b double, a_imputed double, b_imputed double, m_a boolean, m_b boolean")
    l1 = lambda p, q: np.abs(p[:, None] - q[None]).sum()
    assert metrics.pairwise_l1(df, ["a", "b"]).first()["value"] == pytest.approx(l1(x, y))
    assert metrics.energy(df, "a").first()["value"] == pytest.approx(2 * l1(x[:, :1], y[:, :1]) - l1(x[:, :1], x[:, :1]) - l1(y[:, :1], y[:, :1]))
    assert metrics.frechet(df, ["a", "b"]) > 0 and metrics.kl_gaussian(df, ["a", "b"]) > 0
    assert 0 <= metrics.dist_corr_pattern(df, ["a", "b"]) <= 0.5
    with pytest.raises(NotEnoughSamples):
        metrics.kl_gaussian(df.limit(5), ["a", "b"])
    assert set(metrics.correlation_difference(df, ["a", "b"])) == {"a", "b"}


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert linalg.gaussian_kl(np.zeros(2), np.eye(2), np.zeros(2), np.eye(2)) == pytest.approx(0)
    assert linalg.frechet(np.zeros(2), np.eye(2), np.ones(2), 4 * np.eye(2)) == pytest.approx(4)
    x = np.arange(10.0).reshape(5, 2)
    assert (linalg.unfold(linalg.fold(x, 2), x.shape) == x).all()


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, f"g{i % 10}", float(i), N if i % 9 in (3, 4) else float(2 * i)) for i in range(200)], "i int, g string, x double, y double").cache()


GEN = [holes.UniformHoleGenerator, holes.GeometricHoleGenerator, holes.EmpiricalHoleGenerator, holes.MultiMarkovHoleGenerator]


@pytest.mark.parametrize("make", GEN)
def test_masks(series, make):
    kw = {"n_splits": 2, "subset": ["y"], "ratio_masked": 0.1, "order_by": ["i"], "key": ["i"]}
    a = make(seed=1, **kw).split(series).toPandas().sort_values(["fold", "i"], ignore_index=True)
    b = make(seed=1, **kw).split(series).toPandas().sort_values(["fold", "i"], ignore_index=True)
    assert (a["m_y"] == b["m_y"]).all()
    assert not (a["m_y"] & a["y"].isna()).any()
    assert (a.groupby("fold")["m_y"].sum() - 20).abs().max() <= 1
    first, second = (a[a["fold"] == f]["m_y"].to_numpy() for f in (0, 1))
    assert (first != second).any()


def test_grouped_masks_and_errors(series):
    got = holes.GroupedHoleGenerator(subset=["x"], ratio_masked=0.3, groups=["g"], key=["i"]).split(series).groupBy("g").agg(F.avg(F.col("m_x").cast("int")).alias("v")).collect()
    assert sorted(r["v"] for r in got) == [0.0] * 7 + [1.0] * 3
    with pytest.raises(SubsetIsAString):
        holes.UniformHoleGenerator(subset="x")


def test_hole_statistics(series):
    spec = Spec.of(["i"], ["i"])
    assert {r["length"]: r["n"] for r in holes.run_lengths(series, "y", spec).collect()} == {2: 22}
    p = {(r["state"], r["next"]): r["p"] for r in holes.transition_matrix(series, ["y"], spec).collect()}
    assert p[1, 0] == pytest.approx(0.5) and p[1, 1] == pytest.approx(0.5)
    hidden = datasets.add_holes(series, 0.2, 4, ["x"], ["i"])
    assert hidden.where("x is null").count() == 40


def test_missingness_tests(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((200, 2))

    def frame(hidden):
        return spark.createDataFrame([(float(a), N if h else float(b)) for (a, b), h in zip(x, hidden)], "a double, b double")

    q = np.quantile(x[:, 0], 0.9)
    free, tied = frame(rng.random(200) < 0.2), frame(x[:, 0] > q)
    assert mcar.LittleTest().test(free) > 0.05 > mcar.LittleTest().test(tied)
    pklm = mcar.PKLMTest(nb_permutation=20, nb_trees_per_proj=15)
    assert pklm.test(tied) < 0.06
    assert mcar.most_draws(4) == 28
    coded = mcar.encode(spark.createDataFrame([(1, 1.5, "a", True), (N, 2.0, N, False)], "n int, f double, s string, b boolean"))
    assert coded.columns == ["n", "f", "s_a", "b_False", "b_True"]


def test_preprocessing(spark):
    known = spark.createDataFrame([(float(v),) for v in range(1, 6)], "v double")
    asked = spark.createDataFrame([(4.2,), (-1.0,), (3.0,), (4.5,), (12.0,), (N,)], "v double")
    got = [r["v"] for r in preprocessing.BinTransformer(["v"]).fit(known).transform(asked).collect()]
    assert sorted(v for v in got if v is not None) == [1, 3, 4, 5, 5] and got.count(N) == 1
    c = spark.createDataFrame([("a", "c"), ("b", "d"), ("b", "c")], "C1 string, C2 string")
    hot = preprocessing.OneHot(["C1", "C2"]).fit(c)
    assert sorted(hot.reverse(hot.transform(c)).collect()) == sorted(c.collect())
    df = spark.createDataFrame([(float(i), N if i % 5 == 0 else float(2 * i), N if i % 7 == 0 else "AB"[i % 2]) for i in range(60)], "a double, b double, c string")
    done = preprocessing.make_robust_mixte_hgb(df, ["b", "c"], avoid_new=True, maxIter=3)
    assert done.where("b is null or c is null").count() == 0


def test_comparator_and_search(series):
    kw = {"order_by": ["i"], "key": ["i"], "columns": ["y"]}
    models = {"linear": simple.ImputerInterpolation(**kw), "median": simple.ImputerSimple(**kw)}
    gen = holes.UniformHoleGenerator(n_splits=2, subset=["y"], ratio_masked=0.1, key=["i"], order_by=["i"])
    table = Comparator(models, gen, ["mae", "ks_test"]).compare(series.drop("g"))
    assert rank_imputers(table, "mae", "y") == ["linear", "median"]
    best, cost = minimize(lambda p: (p["v"] - 4) ** 2, {"v": ("uniform", 0.0, 10.0)}, 30)
    assert abs(best["v"] - 4) < 1 and cost < 1
    imp = simple.ImputerSimple(strategy="constant", fill_value=0.0, **kw)
    masked, cols = Comparator(models, gen).folds(series.drop("g"))
    assert optimize(imp, masked, cols, "mse", {"fill_value": ("uniform", 0.0, 400.0)}, 6).hyper["fill_value"] > 50
    assert optimize(imp, masked, cols, "mse", {}).hyper == imp.hyper


def test_sources(spark, tmp_path):
    path = tmp_path / "x.tsf"
    path.write_text("# note\n@relation r\n@attribute series_name string\n@attribute state string\n@missing true\n@data\nT1:NSW:1,2,?,4\nT2:VIC:5.5,6,7\n", encoding="cp1252")
    got = {r["series_name"]: r["series_value"] for r in tsf.read_tsf(spark, str(path)).collect()}
    assert got == {"T1": [1.0, 2.0, N, 4.0], "T2": [5.5, 6.0, 7.0]}
    wide = tsf.widen(tsf.read_tsf(spark, str(path))).collect()
    assert [(r["T1"], r["T2"]) for r in wide] == [(1.0, 5.5), (2.0, 6.0), (N, 7.0)]
    with pytest.raises(LacunaError):
        tsf.header(["@attribute a string"])
    assert datasets.artificial(spark, 1000, [100, 20], 0.5, 0.05, 0.1).where("anomaly <> 0").count() in range(30, 75)
    assert datasets.get_data(spark, "Artificial").count() == 1000
    with pytest.raises(UnknownDataset):
        datasets.get_data(spark, "none")
    hours = spark.createDataFrame([(2020, 1, 1, 0, 1.0), (2020, 1, 1, 5, 3.0), (2020, 1, 2, 0, 7.0)], "year int, month int, day int, hour int, v double")
    assert sorted(r["v"] for r in datasets.daily(hours, ["v"]).collect()) == [2.0, 7.0]
    feats = datasets.add_datetime_features(spark.sql("select timestamp'2020-12-31' as t"), "t").first()
    assert feats["time_cos"] == pytest.approx(1) and feats["time_sin"] == pytest.approx(math.sin(2 * math.pi), abs=1e-9)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "g string, t int, x double"
    spark.createDataFrame([("a", 1, 1.0), ("a", 2, N), ("b", 1, N)], schema).coalesce(1).write.parquet(str(src))
    q = stream_locf(spark.readStream.schema(schema).parquet(str(src)), ["x"], ["g"], ["t"]).writeStream.format("memory").queryName("carried").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([("a", 3, N), ("b", 2, 5.0), ("b", 3, N)], schema).coalesce(1).write.mode("append").parquet(str(src))
        q.processAllAvailable()
        got = {(r["g"], r["t"]): r["x"] for r in spark.table("carried").collect()}
    finally:
        q.stop()
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): N, ("a", 3): 1.0, ("b", 2): 5.0, ("b", 3): 5.0}


@pytest.mark.parametrize("make", GEN[1:])
def test_masks_over_blocks(spark, make):
    """A group in several blocks keeps its share; holes stay apart and as long as they were drawn; nothing is placed by a search over all rows."""
    n = 40_000
    rows = spark.range(n).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 40 > 3, 1.0).alias("_x"))
    gen = make(seed=1, subset=["_x"], ratio_masked=0.1, order_by=["id"], groups=["g"], **{"block_rows": 1024})
    got = gen.split(rows).toPandas().sort_values(["g", "id"], ignore_index=True)
    assert len(got) == n and not (got["m__x"] & got["_x"].isna()).any()
    assert (got.groupby("g")["m__x"].sum() - n / 20).abs().max() <= 1
    by_block = got["m__x"].to_numpy().reshape(-1, 500).mean(axis=1)
    assert by_block.min() > 0.02 and by_block.max() < 0.25
    if make is holes.EmpiricalHoleGenerator:  # holes of two rows a group
        m = np.r_[False, got["m__x"].to_numpy(), False].astype(int)
        edges = np.flatnonzero(np.diff(m))
        assert np.mean(edges[1::2] - edges[::2] == 2) > 0.99


def test_every_free_cell_is_hidden_if_asked(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 3, 1.0).alias("x"))
    for ratio, want in ((1.0, 2571), (0.8, 2400)):
        got = holes.GeometricHoleGenerator(subset=["x"], ratio_masked=ratio, order_by=["id"], block_rows=256).split(rows)
        assert got.where("m_x").count() == want


def test_placing_takes_one_search_a_length():
    free = np.ones(400_000, bool)
    start = time.process_time()
    mask = holes.place(free, {1: 30_000, 2: 5_000}, np.random.default_rng(0))
    assert mask.sum() == 40_000 and time.process_time() - start < 10


def test_scores_need_no_join_by_key(series):
    """Truth and masks travel with their rows, and give what a join by key gives."""
    masked = series.withColumns({"m_y": (F.col("i") % 11 == 2) & F.col("y").isNotNull(), "fold": F.lit(0)})
    kw = {"order_by": ["i"], "key": ["i"], "groups": ["g"]}
    told, untold = refilled(simple.ImputerLOCF(columns=["x", "y"], **kw), masked, ["y"]), refilled(simple.ImputerLOCF(**kw), masked, ["y"])
    names = ["i", "g", "x", "y", "m_y", "y_imputed"]
    assert sorted(map(str, told.select(names).collect())) == sorted(map(str, untold.select(names).collect()))
    curve = refilled(simple.ImputerInterpolation(method="cubic", columns=["x", "y"], **kw), masked, ["y"])  # through pandas
    assert sorted(map(str, curve.select("i", "y").collect())) == sorted(map(str, masked.select("i", "y").collect()))
    plan = refilled(simple.ImputerSimple(strategy="constant", columns=["y"], key=["i"]), masked, ["y"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
