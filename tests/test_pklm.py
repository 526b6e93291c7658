"""The PKLM test over blocks, and exact order statistics by counting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.errors import LacunaError
from lacuna.functions.select import from_ordered_bits, order_statistics, ordered_bits
from lacuna.operators import mcar
from lacuna.plans import catalogue
from lacuna.storage import Scratch


def test_order_statistics(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=700) * 1e3, "b": 1.7e9 + rng.integers(0, 40, 700), "c": np.repeat([-0.0, 0.0, -2.5, 7.0, 5e-324, -1e300, 3.0], 100)})
    pdf.loc[::3, "a"] = np.nan
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 2.0, np.inf])
    assert (np.diff(ordered_bits(x).astype(object)) > 0).all() and (from_ordered_bits(ordered_bits(x)) == x).all() and ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))
    ranks = {"a": [0, 10, 233, 465], "b": list(range(0, 700, 50)), "c": [0, 99, 100, 350, 699]}
    got = order_statistics(spark.createDataFrame(pdf).repartition(5), ranks)
    for c in ranks:
        assert got[c] == list(np.sort(pdf[c].dropna())[ranks[c]])
    assert order_statistics(spark.createDataFrame(pdf), {"a": []}) == {"a": []}


def table(spark, n, tied, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    hidden = x[:, 0] > 0.8 if tied else rng.random(n) < 0.2
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["d"] = np.where(rng.random(n) < 0.5, 1.0, 2.0)  # few values
    pdf.loc[hidden, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    return spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abcd"})


def test_blocks_change_only_permutations(spark):
    df = table(spark, 300, True)
    small = {"nb_projections": 3, "nb_projections_threshold": 1, "nb_permutation": 9, "nb_trees_per_proj": 12}
    one, many = mcar.PKLMTest(**small).statistics(df), mcar.PKLMTest(**small, block_rows=80).statistics(df.repartition(7))
    assert one[:, 0] == pytest.approx(many[:, 0], rel=1e-9) and one.shape == many.shape == (3, 10)
    assert not np.allclose(one[:, 1:], many[:, 1:])
    assert mcar.PKLMTest(**small).statistics(df.repartition(3)) == pytest.approx(one)


def test_units_of_one_projection_stay_spread(spark, monkeypatch):
    """One count grows a forest of few lines over blocks, and a projection's blocks do not meet in one task."""
    seen, saved, sums, save = {}, [], mcar.PKLMTest._sums, Scratch.save

    def watch(self, units):
        seen["parts"] = units.select(F.spark_partition_id().alias("p")).distinct().count()
        return sums(self, units)

    monkeypatch.setattr(mcar.PKLMTest, "_sums", watch)
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t", tidy=True: saved.append(name) or save(self, df, name, tidy))
    small = {"nb_permutation": 3, "nb_trees_per_proj": 12}
    df = table(spark, 4000, True).select("a", "b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = mcar.PKLMTest(**small, block_rows=700).statistics(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen["parts"] > 1 and saved.count("forests") == 1 and not [n for n in saved if n.startswith("level")]
    assert mcar.PKLMTest(**small).statistics(df)[:, 0] == pytest.approx(many[:, 0], rel=1e-9)


def test_decisions_take_no_window_over_the_table(spark, tmp_path, monkeypatch):
    spark.range(41).selectExpr("id AS c_custkey", "(id * 17 % 41) / 3 AS c_acctbal", "id % 5 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(41).selectExpr("id AS event_id", "(id * 17 % 41) / 3 AS value", "id % 5 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    for test, name in ((mcar.PKLMTest, "pklm_decision"), (mcar.LittleTest, "little_decision")):
        asked = []
        monkeypatch.setattr(test, "test", lambda self, df, asked=asked: asked.append(df) or 0.5)
        catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(asked) == 2 and not any("Window" in df._jdf.queryExecution().toString() for df in asked)
        assert sorted(df.where("b IS NOT NULL").count() for df in asked)[0] == 20  # 41 values, of which 20 lie below the median


def test_codes_do_not_depend_on_blocks(spark):
    df = mcar.canonical(table(spark, 200, False))
    scratch = Scratch(spark)

    def codes(block_rows):
        got = {}
        for r in mcar.coded_blocks(df, scratch, 8, block_rows).collect():
            for k, at in enumerate(np.frombuffer(r["place"], np.int64)):
                got[at] = tuple(c[k] for c in r["codes"])
        return got

    whole = codes(1000)
    assert sorted(whole) == list(range(200)) and whole == codes(60)
    swapped = [(float(i), None) if j else (None, float(i)) for i in range(40) for j in (0, 1)]
    df = spark.createDataFrame(swapped, "a double, b double")
    assert codes(1000) == codes(30)  # the same numbers in other columns are other rows


def test_decisions(spark):
    quick = {"nb_permutation": 39, "nb_trees_per_proj": 25}
    p, by = mcar.PKLMTest(**quick, compute_partial_p_values=True).test(table(spark, 400, True))
    assert p < 0.06 and list(by) == list("abcd") and by["b"] > p
    # One table missing at random may be rejected, at the level's rate (seed 3 has p = 0.05); most must not be.
    assert np.median([mcar.PKLMTest(**quick).test(table(spark, 400, False, seed)) for seed in range(3, 8)]) > 0.06


def test_u_hat():
    p, y = np.array([0.9, 0.5, 0.1, 1.0]), np.array([1, 1, 0, 0])
    odds = np.log([9, 1, 1 / 9, (1 - 1e-9) / 1e-9])
    assert mcar.u_hat(p, y) == pytest.approx(odds[:2].mean() - odds[2:].mean(), rel=1e-6)


def test_nothing_to_test(spark):
    full = spark.createDataFrame([(float(i), float(i % 7)) for i in range(40)], "a double, b double")
    for df in (full, full.where("a < 0"), full.select("a"), full.withColumn("b", F.lit(None).cast("double"))):
        with pytest.raises(LacunaError):
            mcar.PKLMTest(nb_permutation=2, nb_trees_per_proj=2).test(df)
