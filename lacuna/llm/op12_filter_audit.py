"""Audit of how document filters overlap, for every order in which they may run.

Each document gets five failure flags.  Documents are counted by part and flags;
CUBE over the five flags and the part then gives, in the grouping sets that name
the part and some of the flags, the rows in which all of those flags are false:
the survivors of that subset of filters.  A step of an order leads from one
subset to another with one filter more, so all its figures come from joining the
survivors of the two: what a filter removes is their difference, and its Shapley
value is the sum of its differences over all subsets, each as often as orders
reach it.

Flag E needs the smallest doc_id of each text.  Texts are digests by then, and
equal ones with equal doc_id, part, flags and labels are counted before anything
is gathered by digest; what meets there are counts by part, label and flags,
not documents, so that no number of copies makes a large group.

Defined cases: a null text counts as empty, a null lang as part ''.  A null doc_id
is not smaller than any and none is smaller than it: E does not hold, but its
copies count for nothing either; it has no labels.  Rows with equal doc_id and
text are each counted, and neither is a copy of the other.  A document is good or
toxic if any of its label rows says 1; nulls there say nothing.  An empty table
gives no rows.  Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

FILTERS = "ABCDE"
#: Fixed values of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "#$%&*|"
FIGURES = ("n", "good", "toxic")
SPACE = "\t\n\x0b\x0c\r"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text that is not null fails A, B, C and D."""
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(f"[{SIGNS}]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and the five flags: ``n`` of them, and how many are ``good`` and ``toxic``."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality"), said("toxic"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[f.alias(k) for k, f in text_flags(text).items()])
    kinds = ["digest", "part", "A", "B", "C", "D", "quality", "toxic"]
    no = F.lit(False)
    marked = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("quality", "toxic")})
    equal = marked.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    # Of each kind: how many rows, its smallest doc_id, and how many of the rows have that or none.
    kind = equal.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    split = kind.withColumn("firsts", F.when(F.col("least") == first, F.col("at_least")).otherwise(0) + F.col("no_id"))
    sides = F.explode(F.array(F.struct(no.alias("E"), F.col("firsts").alias("n")), F.struct((~no).alias("E"), (F.col("n") - F.col("firsts")).alias("n"))))
    rows_of = split.select("part", "A", "B", "C", "D", "quality", "toxic", sides.alias("side")).select("*", "side.E", "side.n").drop("side")
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias({"quality": "good"}.get(c, c))
    return rows_of.where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), when("quality"), when("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """For each part and each subset of the filters (``mask``: bit i for filter i) what passes all of the subset, zeros included."""
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in FIGURES], *[F.grouping(c).alias(f"no_{c}") for c in ("part", *FILTERS)])
    passed = [(F.col(f"no_{c}") == 1) | ~F.col(c) for c in FILTERS]
    mask = sum((1 - F.col(f"no_{c}").cast("int")) * (1 << i) for i, c in enumerate(FILTERS))
    found = cube.where("no_part = 0").where(F.array_min(F.array(*passed))).select("part", mask.alias("mask"), *FIGURES)
    # The empty subset has a row for every part.
    every = found.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in FIGURES])


def steps() -> list[tuple[str, int, str, int, int]]:
    """All steps of all orders: order, step, filter, subset before and subset after."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order, 1):
            out.append(("".join(FILTERS[g] for g in order), i, FILTERS[f], before, before | 1 << f))
            before |= 1 << f
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts that the step's filter makes there."""
    spark, k = docs.sparkSession, len(FILTERS)
    left = survivors(flag_counts(docs, labels))
    full = (1 << k) - 1
    # All pairs of subsets that differ by one filter; orders that pass through a pair: those of the filters before times those of the filters after.
    pairs = [(f, s, s | 1 << i, factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))) for i, f in enumerate(FILTERS) for s in range(1 << k) if not s >> i & 1]
    pairs = F.broadcast(spark.createDataFrame(pairs, "filter string, mask int, after int, orders long"))
    after = left.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in FIGURES])
    moved = left.join(pairs, "mask").join(after, ["part", "after"])
    moved = moved.select("part", "filter", F.col("mask").alias("before"), "after", "orders", F.col("n_after").alias("kept"), *[(F.col(c) - F.col(f"{c}_after")).alias(c) for c in FIGURES])
    one = Window.partitionBy("part", "filter")
    figures = moved.select(
        "part", "filter", "before", "kept", F.col("n").alias("removed"),
        (F.sum(F.when(F.col("before") == 0, F.col("n"))).over(one) - F.col("n")).alias("redundant"), F.sum(F.when(F.col("after") == full, F.col("n"))).over(one).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum(F.col("n") * F.col("orders")).over(one).alias("shapley"),
    )
    every = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int").drop("after"))
    return figures.join(every, ["filter", "before"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id
), grouped AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), pairs AS (
  SELECT part, o, s, ascii(o[s]) - 64 AS f, list_transform(range(1, s), lambda i: ascii(o[i]) - 64) AS earlier
  FROM (SELECT DISTINCT part FROM grouped), orders, (SELECT unnest(range(1, 6)) AS s)
), judged AS (
  SELECT p.part, o, s, f, n, good, toxic, fails[f] AS failed, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_failed
  FROM pairs p JOIN grouped g ON p.part = g.part
), counted AS (
  SELECT part, o AS filter_order, s::INT AS step, substr('ABCDE', f::INT, 1) AS filter,
         coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed AND n_failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""
