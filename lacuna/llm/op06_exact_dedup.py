"""Exact dedup by a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form (A-Z lower-cased,
nothing else).  A Misra-Gries pass finds the digests that may hold more than
``1 / counters`` of all rows; their exact counts and winners are then verified
and, being at most ``counters`` rows whatever the input, broadcast.  Rows of
those groups are decided where they are read.  All other groups are small, so
an ordinary shuffle on the digest is even.

Defined cases: a null text counts as empty; a null ``doc_id`` is the smallest;
of rows with equal text and equal ``doc_id`` one stays.  An empty table gives
no rows.  Columns of the input other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Misra-Gries counters: a digest with more than 1/COUNTERS of the rows is certain to be found.
COUNTERS = 256


def misra_gries(counters: int):
    """Summarises a partition's digests: at most ``counters`` rows (digest, lower bound), and the rows seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for pair in batch.column(0).value_counts():
                d, n = pair["values"].as_py(), pair["counts"].as_py()
                kept[d] = kept.get(d, 0) + n
            if len(kept) > counters:  # take the (counters + 1)-th largest count from all: the batch form of the decrement
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*kept, None], pa.binary()), pa.array([*kept.values(), rows], pa.int64())], ["digest", "n"]
            )

    return run


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; the largest doc_id of equal texts stays."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(
        docs.select(
            F.col("doc_id"),
            F.unhex(F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    summary = rows.select("digest").mapInArrow(misra_gries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    summary = scratch.save(summary, "summary")
    total = summary.where(F.col("digest").isNull()).agg(F.sum("n")).first()[0] or 0
    # A digest's summed lower bound is short of its count by total / counters at most, so with a bound
    # above zero at least; those whose bound passes half the share number at most 2 * counters.
    share = total / (2 * counters)
    candidates = summary.where(F.col("digest").isNotNull() & (F.col("n") > share)).select("digest")
    heavy = scratch.save(
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size")),
        "heavy",
    )
    verdict = heavy.select("digest", F.col("winner.doc_id").alias("keep_id"), F.col("winner.row").alias("keep_row"), "group_size")
    split = rows.join(F.broadcast(verdict), "digest", "left")
    decided = split.where(F.col("group_size").isNotNull()).withColumn("kept", F.col("row") == F.col("keep_row"))
    by = Window.partitionBy("digest")
    first = by.orderBy(F.col("doc_id").desc_nulls_last(), F.col("row").desc())
    light = (
        rows.join(F.broadcast(verdict.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.first("doc_id").over(first))
        .withColumn("kept", F.row_number().over(first) == 1)
        .withColumn("group_size", F.count("*").over(by))
    )
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return decided.select(*out).unionAll(light.select(*out))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
