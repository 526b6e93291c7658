"""Mixing sources to target weights by cube-method balanced sampling.

A source with words S and target T repeats each document floor(T / S) times and
takes a fraction pi = T / S - floor(T / S) of the documents once more.  Which
ones is decided by the cube method: inclusion probabilities, all pi at first,
move inside the null space of two constraints (the number of documents and the
words taken) until they hit 0 or 1, so both totals stay where they were.  The
walk takes three undecided documents at a time, hence is linear.  It runs in
blocks of hashed documents of one source; what a block leaves undecided (at most
two documents) meets the leftovers of other blocks in the next round, until a
source has one block.  That one stops at twelve undecided documents, and the
landing phase takes the subset of these that keeps the source's words nearest to
its target.

Every choice comes from a hash of the document's id and words and a seed, so
reruns agree under any partitioning.

Defined cases: a null text has size 0, as has one without words; such documents
take part and take 0 words.  A null source is a source of its own, after all
others.  Rows with equal doc_id are told apart by their size, and where that is
equal too, get equal draws in some order.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

#: Weights of sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A target stops at this many times its source's size.
MOST = 3.0
#: Documents walked together in one task.
BLOCK = 2_000
SEED = 20240611
#: Documents of a source that its landing phase decides together, over all their subsets.
LEAVE = 12


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets of sources (source, source_size): shares of the whole by weight, capped, the excess reshared.

    Resharing until nothing is above its cap ends at min(cap, level * weight)
    with one level for all.  Sources in order of cap / weight are capped up to
    some rank; running sums give the level for each rank, and the first that
    caps no further source is the one.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ratio = Window.orderBy("cap_per_weight", "rank")
    up = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*map(F.lit, weights))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(w, F.pmod("rank", F.lit(len(weights))) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
    )
    fits = F.when(F.col("level") <= F.col("cap_per_weight"), F.struct("cap_per_weight", "rank", "level"))
    level = F.min(fits).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.max("cap_per_weight").over(every)) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, draw: np.ndarray, leave: int = 2) -> np.ndarray:
    """Moves inclusion probabilities in the null space of (count, words) until at most ``leave`` (2 or more) are undecided.

    With three documents the null space of the two constraints is the line
    (s3 - s2, s1 - s3, s2 - s1); with equal sizes, (1, -1, 0).
    """
    p, s = pi.tolist(), size.tolist()
    eps = 1e-9
    live: list[int] = []
    todo = [k for k in range(len(p)) if eps < p[k] < 1 - eps]
    for n, k in enumerate(todo):
        if len(live) + len(todo) - n <= leave:
            break
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, v in zip(live, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        # A martingale step: the expectation of each probability is what it was.
        step = up if draw[k] * (up + down) < down else -down
        kept = []
        for i, v in zip(live, u):
            x = p[i] + step * v
            if x <= eps or x >= 1 - eps:
                p[i] = float(round(x))
            else:
                p[i] = x
                kept.append(i)
        live = kept
    return np.array(p)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides what the last flight left: of all subsets, the one nearest to the words, then the documents, they stand for."""
    p = np.where(pi <= 1e-9, 0.0, np.where(pi >= 1 - 1e-9, 1.0, pi))
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        takes = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(takes @ size[left] - np.dot(p[left], size[left])).round(6)
        count = np.abs(takes.sum(axis=1) - p[left].sum())
        p[left] = takes[np.lexsort((count, words))[0]]
    return p


def _walk(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["draw", "doc_id", "size"], kind="stable", na_position="first")
        size = block["size"].to_numpy(np.float64)
        p = flight(block["pi"].to_numpy(), size, block["coin"].to_numpy(), LEAVE if last else 2)
        return block.assign(pi=landing(p, size) if last else p)

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    goal = scratch.save(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets"
    )
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = (
        sized.join(goal, sized["source"].eqNullSafe(goal["source"]))
        .select(sized["doc_id"], sized["source"], "size", "source_size", "rank", "target")
        .withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("times") + 1e-9).cast("long"))
        .withColumn("pi", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
        .withColumn("draw", h)
        .withColumn("coin", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    )
    keep = ["doc_id", "source", "size", "source_size", "rank", "target", "whole", "pi", "draw", "coin"]
    state = scratch.save(rows.select(*keep), "start")
    undecided = (F.col("pi") > 1e-9) & (F.col("pi") < 1 - 1e-9)
    done = [state.where(~undecided)]
    live = state.where(undecided)
    level = 0
    while True:
        counts = live.groupBy("rank").agg(F.count("*").alias("rows"))
        largest = counts.agg(F.max("rows")).first()[0] or 0
        if not largest:
            break
        last = largest <= block
        blocks = F.ceil(F.col("rows") / F.lit(block)).cast("long")
        dealt = live.join(counts, "rank").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "draw"), blocks))
        walked = dealt.groupBy("rank", "block").applyInPandas(_walk(last), dealt.schema).select(*keep)
        state = scratch.save(walked, f"flight{level}")
        done.append(state if last else state.where(~undecided))
        if last:
            break
        live = state.where(undecided)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    copies = F.col("whole") + F.round("pi").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")
