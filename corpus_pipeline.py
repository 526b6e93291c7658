"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the
last return the columns of ``documents`` (doc_id, text, lang, source, n_chars),
with n_chars the length of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import KeyMap, Scratch, table
from lacuna.llm.op01_line_dedup import dedup_lines
from lacuna.llm.op02_jaccard import near_duplicates
from lacuna.llm.op03_packing import pack
from lacuna.llm.op09_toxicity import score_toxicity
from lacuna.llm.op10_mixing import mix_sources, n_words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; a text without evidence stays, so do null and empty ones."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are near one, go; every document stays, if with an empty text.

    All lines but empty ones are compared for equality, those of 32 bytes or more
    also for being within two byte edits.
    """
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays: that with the smallest doc_id, of equals the smallest text hash.

    Rows with one doc_id and texts that are not near each other all stay; rows
    equal in doc_id and text are one.  A row without an id comes after those with
    one.  Null and empty texts, and those without words, are near nothing and stay.
    Only rows that go, or that repeat, are shuffled with their texts.
    """
    scratch = Scratch(spark)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    places = near_duplicates(docs).where("cluster IS NOT NULL").groupBy(order.alias("place")).agg(F.min("cluster").alias("cluster"), F.count("*").alias("n"))
    places = scratch.save(places, "places")
    first = places.groupBy("cluster").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("stays"))
    touched = scratch.save(places.join(first, "place", "left").where("stays IS NULL OR n > 1").select("place", F.coalesce("stays", F.lit(False)).alias("stays")), "touched")
    rows = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("place"))
    maybe = KeyMap(touched.select(F.xxhash64("place").alias("k")), "k").has(F.xxhash64("place"))
    met = rows.where(maybe).join(touched, "place", "left")
    once = Window.partitionBy("place").orderBy("source", "lang", "n_chars")
    kept = met.where("stays").withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return rows.where(~maybe).select(*COLUMNS).unionAll(met.where("stays IS NULL").select(*COLUMNS)).unionAll(kept.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it; those it takes no time go.

    Null and empty texts take part with size 0 and count nothing.  A null source is a
    source of its own, the last.  Rows alike in id, source and size are told apart by
    their texts; of those the one first in text hash is taken most.
    """
    taken = mix_sources(docs).select("doc_id", "source", "size", "copies")
    by = ["doc_id", "source", "size"]
    sized = docs.select(*COLUMNS, n_words(F.col("text")).alias("size"))
    # Rows that are alike in id, source and size meet by their rank, so that each decision is used once.
    a = sized.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("text"))))
    b = taken.where("copies > 0").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("copies"))))
    b = b.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_n").alias("_k"), "copies")
    same = [a[c].eqNullSafe(b[f"_{c}"]) for c in by] + [a["_n"] == b["_k"]]
    return a.join(b, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids; a null or empty text is one piece, the end id, and every row is packed."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL cannot express the toxicity model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are stored before the next reads them."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
