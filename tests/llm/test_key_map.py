"""The map of keys: no key of the table is lost, and its pages reach the tasks as a broadcast table."""

from pyspark.sql import functions as F

from lacuna.llm.common import KeyMap


def test_found_keeps_every_key_and_carries_no_subquery(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(-500, 6000).select(F.when(F.col("id") >= 0, F.xxhash64("id")).alias("key"), "id", F.lit(1).alias("page"), F.lit("w").alias("words"))
    some = KeyMap(keys, "key")
    found = some.found(rows, "key")
    assert found.columns == rows.columns
    got = [r["id"] for r in found.collect()]
    assert sorted(got) == sorted(r["id"] for r in rows.where(some.has(F.col("key"))).collect())
    assert {*range(3000)} <= {*got} and len(got) == len({*got}) < 3200
    # One value of 16 MB in every plan and task had the driver hold many copies of it.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ubquery" not in plan and "BroadcastHashJoin" in plan
    assert KeyMap(keys.limit(0), "key").found(rows, "key").count() == 0
    assert found.where("id < 0").count() == 0
