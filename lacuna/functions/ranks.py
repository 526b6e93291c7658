"""Places of rows in their group's order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch


def ranked(rows: DataFrame, group: str, order: str, scratch: Scratch, rank: str = "i", parts: int | None = None) -> DataFrame:
    """``rows`` with the 0-based place of each among those of its ``group``, by ``order``.

    The rows are dealt by ranges of (group, order), so a large group lies in several
    tasks; each counts its rows by group, and a row's place is its place in its range
    after all rows of earlier ranges.  The dealt rows are stored, so that ranges stay.
    """
    n = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.save(rows.repartitionByRange(n, group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")), "starts", tidy=False)
    place: Column = F.row_number().over(Window.partitionBy("_range", group).orderBy(order)) - 1
    met = dealt.withColumn(rank, place).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return met.withColumn(rank, F.col(rank) + F.col("_start")).drop("_range", "_group", "_at", "_start")
