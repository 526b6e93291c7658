"""Spelling variants grouped through bands of letter-parity bitmasks.

A word's mask has a bit for each letter (letters may share one), set where the
letter occurs an odd number of times.  One inserted, deleted or replaced letter
flips two bits at most, so of three bands of the mask one at least is equal in
two near words.  Words meet in equal bands and lengths; a band's value is common
in a large vocabulary, so the half of the word that the edit left alone is part
of the key: an edit behind the middle leaves the first half, one before it the
last.  A pair that shares several keys counts in the first.  What meets differs
in at most two bits and is then verified by edit distance.

Words are counted over all documents before anything is joined, so how often a
word occurs has no weight in the join.  A form occurs five times as often as the
word that it explains, so chains of forms are shorter than 28 links whatever the
input; doubling follows them in five rounds at most.

Defined cases: a null or empty text has no words; a null doc_id counts as '' in
the hash; rows with equal doc_id are each counted.  Without words there are no
rows.  Columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs so many times as often as its variant.
RATIO = 5
#: One run in so many, by its hash, loses a code point.
SLIP = 199
#: Bits of a mask; bit b belongs to band b % BANDS.
BITS, BANDS = 63, 3
BAND_BITS = [sum(1 << b for b in range(i, BITS, BANDS)) for i in range(BANDS)]


def runs(docs: DataFrame, least: int = LEAST_LENGTH, slip: int = SLIP) -> DataFrame:
    """Every run of letters as it counts: lower-cased, and with a code point less where its hash says so."""
    # A run shorter than a word cannot become one.
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    run = F.col("run")
    low = found.select("doc_id", F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return low.select(F.when(F.pmod(h, F.lit(slip)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word")).where(F.length("word") >= least)


def parity(word: Column) -> Column:
    """The word's letter-parity mask."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words (word, n) at edit distance one, once: ``a``, ``a_n``, ``b``, ``b_n``, the shorter first."""
    w, size = F.col("word"), F.length("word")
    masked = words.select("word", "n", parity(w).alias("mask"))

    def keyed(length: Column) -> Column:
        """The keys under which a word meets others, the shorter having ``length`` letters."""
        half = F.floor(length / 2).cast("int")
        halves = [F.left(w, half), F.right(w, length - half)]
        key = lambda i, j: F.xxhash64(length, F.lit(2 * i + j), F.col("mask").bitwiseAND(F.lit(BAND_BITS[i])), halves[j])
        return F.array(*[F.struct(F.lit(2 * i + j).alias("which"), length.alias("length"), key(i, j).alias("key")) for i in range(BANDS) for j in range(2)])

    longer = F.when(size > LEAST_LENGTH, keyed(size - 1)).otherwise(F.array().cast("array<struct<which:int,length:int,key:bigint>>"))
    a = masked.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.inline(keyed(size)))
    b = masked.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), F.inline(F.concat(keyed(size), longer))).withColumnRenamed("length", "b_length").withColumnRenamed("which", "b_which")
    flips, half = F.col("a_mask").bitwiseXOR(F.col("b_mask")), F.floor(F.col("length") / 2).cast("int")
    band = F.when(flips.bitwiseAND(F.lit(BAND_BITS[0])) == 0, 0).when(flips.bitwiseAND(F.lit(BAND_BITS[1])) == 0, 1).otherwise(2)
    first = 2 * band + F.when(F.left("a", half) == F.left("b", half), 0).otherwise(1)
    once = (F.length("b") > F.col("length")) | (F.col("a") < F.col("b"))
    met = (F.bit_count(flips) <= 2) & (F.col("length") == F.col("b_length")) & (F.col("which") == F.col("b_which")) & once & (F.col("which") == first)
    return a.join(b, "key").where(met & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For each word with a form the last of its chain of forms: every round doubles the links followed."""
    found = scratch.save(links.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.save(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        found = after.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
    ways = F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]))
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rank"), "near")))
    judged = none.unionAll(near_pairs(words).select(ways)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    judged = judged.withColumn("best", F.when(-F.col("best.rank") >= ratio * F.col("n"), F.col("best")))
    links = scratch.save(judged.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.rank")).alias("form_n")), "links")
    return links.join(roots(links, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), counted AS (
  SELECT id, r, count(*) AS k, hex(encode(id || ':' || r)) AS x FROM run GROUP BY id, r
), hashed AS (
  SELECT r, k, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
                                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc
), word AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM word, unnest(range(1, length(word) + 1)) u(i)
), pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN word w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pair GROUP BY word
), form AS (
  SELECT word.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM word LEFT JOIN best ON word.word = best.word
), walk AS (
  SELECT word, word AS root FROM form
  UNION SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL
)
SELECT form.word, form, root, n, n_near, form_n
FROM form JOIN walk ON form.word = walk.word
WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.word = walk.root AND f.form IS NOT NULL)
"""
