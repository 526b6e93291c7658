"""Scratch tables, inputs and splits shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch  # noqa: F401  the operators' import

#: Every document's remainder decides on which side of the fixed hold-out split it is.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text has remainder 2 modulo 4; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT_REMAINDER


#: Bits of a map of keys, at most: 16 MB.
MAP_BITS = 27
#: Bits of one page of it, and of one word of a page.
PAGE, WORD = 15, 5


class KeyMap:
    """A bit map of hashed keys, of bounded size, that tells rows apart before they are shuffled.

    A row whose key is in the table is always found; others are let through the
    more often the fuller the map is, which costs time and changes no result.
    The map is a scalar subquery, so tasks look keys up within their own stage.
    """

    def __init__(self, keys: DataFrame, column: str, most: int = MAP_BITS):
        spark, key = keys.sparkSession, F.col(column)
        self.bits = min(most, max(PAGE, (512 * keys.count()).bit_length()))
        low = F.pmod(key, F.lit(1 << self.bits))
        pages = keys.select(F.shiftright(low, PAGE).alias("page"), F.pmod(key, F.lit(1 << PAGE)).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("map"))
        word = lambda i: F.conv(F.hex(F.substring("map", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
        words = F.transform(F.sequence(F.lit(0), F.lit((1 << (PAGE - WORD)) - 1)), lambda i: F.coalesce(signed(word(i)), F.lit(0)))
        self.pages = pages.select("page", words.alias("words"))
        every = spark.range(1 << (self.bits - PAGE)).withColumnRenamed("id", "page").join(pages, "page", "left")
        self.words = every.select("page", words.alias("words")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "words"))), lambda x: x["words"]).alias("words")).scalar()

    def has(self, key: Column) -> Column:
        """Whether the key may be in the table; null for a null key."""
        return self._bit(F.get(self.words, F.shiftright(self._low(key), PAGE)), key)

    def _low(self, key: Column) -> Column:
        return F.pmod(key, F.lit(1 << self.bits)).cast("int")

    def _bit(self, words: Column, key: Column) -> Column:
        """Whether the key's bit is set in its page."""
        at = self._low(key).bitwiseAND(F.lit((1 << PAGE) - 1))
        # A word's first byte is its highest.
        shift = (3 - F.shiftright(at, 3).bitwiseAND(F.lit(3))) * 8 + at.bitwiseAND(F.lit(7))
        return F.call_function("shiftright", F.get(words, F.shiftright(at, WORD)), shift).bitwiseAND(F.lit(1)) == 1

    def found(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be in the table."""
        key, pages = rows[column], self.pages.toDF("page_", "words_")
        return rows.join(F.broadcast(pages), (F.shiftright(self._low(key), PAGE).cast("long") == pages["page_"]) & self._bit(pages["words_"], key), "left_semi")


def thin(rows: DataFrame, about: int, seed: int = 7) -> DataFrame:
    """``rows`` (with doc_id) thinned by a hash of doc_id to ``about`` of them; all, if they are fewer."""
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(about / n * (1 << 30)))
