"""Connected components by repeated contraction, all state in stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, jumps: int = 2) -> DataFrame:
    """(id, comp) for every endpoint of ``edges`` (a, b): comp is the smallest id of its component.

    Each round points every vertex to its smallest neighbour or itself, follows
    these pointers ``2 ** jumps`` steps, and contracts the edges to where they
    lead.  Nothing is collected but the number of edges left.  A vertex with very
    many neighbours is one row after map-side combining.
    """
    edges = scratch.save(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while edges.count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        step = scratch.save(step, "pointers")
        for _ in range(jumps):
            ahead = step.select(F.col("v").alias("to"), F.col("to").alias("further"))
            step = step.join(ahead, "to", "left").select("v", F.coalesce("further", "to").alias("to"))
        step = scratch.save(step, "pointers")
        labels = scratch.save(labels.join(step.withColumnRenamed("v", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
        left, right = step.select(F.col("v").alias("a"), F.col("to").alias("ta")), step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where(F.col("ta") != F.col("tb"))
        edges = scratch.save(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return labels
