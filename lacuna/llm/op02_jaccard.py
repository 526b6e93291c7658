"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

Documents link when the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; the result is exact but for collisions of 64-bit
hashes.

1. Rows with equal sets form one class, named by a 64-bit digest of its set;
   classes are joined, not rows, so a group of copies costs what one costs, and
   rows with equal doc_id and different texts are told apart.
2. A sketch counts shingles in a fixed number of buckets.  It only orders
   shingles, rare first; any order is right.  Of a set of n shingles the
   n - ceil(0.8 n) + c rarest hold at least c of those it shares with any partner.
3. Small sets enumerate all pairs (c = 2) of that prefix and meet where a pair is
   equal; large sets scan the inverted lists of the shingles of theirs (c = 1).
   The boundary is the size with the least cost: keys emitted against the lengths
   of the lists, which the sketch estimates.  Sets within 1/0.8 of the boundary do
   both, so no pair across it is lost.
4. Keys carry their place in the set's order.  A pair is a candidate at a key only
   if what comes after it in both sets leaves enough to share, so a copy with many
   shingles of its own meets few others.  Lists of at most ``light`` sets give all
   their candidates.
   Longer ones are cut down first: the set whose shingles are commonest is
   compared with all others, those found linked become one component, and the
   next round takes the commonest of what is left.  After ``pivots`` rounds the
   sets outside a list's main component meet every set of another component.
   Pairs inside one component need no test, so a list of near copies costs its
   length and not its square.
5. Candidates are verified on whole sets, and components contracted.

Defined cases: a null or empty text or one without words has an empty set and
links with nothing; a text of one to four words has one shingle, its words.  Each
row is a vertex of its own: rows with equal doc_id and different texts link by
their texts only, each with its own component.  A component takes the smallest
doc_id of its rows; a null doc_id gives no component its id, so it is null where
all are.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import KeyMap, Scratch, table
from .components import components

K = 5
PERCENT = 80
LIGHT = 32
PIVOTS = 2
SLICES = 64
#: Counters of the sketch: 2 bytes each, so at most 16 MB are broadcast whatever the input.
LEAST_BITS, MOST_BITS = 12, 23
#: Sets larger than this are large in any case.
MOST_SMALL = 64


def needed(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Shingles that a set of ``n`` shares at least with any partner."""
    return (percent * n + 99) // 100


def prefix_size(n: int, c: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + c)


def _sketch(bits: int, k: int):
    """Counts of shingles by their top bits, in slices: (slice, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for _, _, raw, offs in tk.chunks(data, offsets):
                sets = tk.shingle_sets(raw, offs, k)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                slot, n = np.unique((every >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                counts[slot] += n.astype(np.int32)
        part = TaskContext.get().partitionId() % 64
        cut = np.minimum(counts, 65535).astype("<u2").reshape(min(SLICES, 1 << bits), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), part, np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], ["slice", "part", "counts"]
        )

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["counts"].iloc[0]) // 2, np.int64)
    for c in group["counts"]:
        total += np.frombuffer(c, "<u2")
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})


def sketch_of(docs: DataFrame, bits: int, k: int = K) -> np.ndarray:
    schema = "slice int, part int, counts binary"
    parts = docs.select("text").mapInArrow(_sketch(bits, k), schema)
    merged = parts.groupBy("slice", "part").applyInPandas(_add, schema).groupBy("slice").applyInPandas(_add, schema)
    rows = merged.orderBy("slice").collect()  # 2 ** bits counters in all
    return np.concatenate([np.frombuffer(r["counts"], "<u2") for r in rows]) if rows else np.zeros(1 << bits, np.uint16)


def digest(s: np.ndarray) -> np.uint64:
    """The name of a class: a digest of its sorted set."""
    with np.errstate(over="ignore"):
        return tk.mix(s + np.uint64(1)).sum(dtype=np.uint64)


def _describe(sketch, k: int, percent: int):
    """(doc_id, text_hash, n, d1, d2, common, scan): a set's size, digest, the commonness of its shingles, and the lengths of its prefix's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(math.log2(len(sketch.value))))
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for first, end, raw, offs in tk.chunks(data, offsets):
                sets = tk.shingle_sets(raw, offs, k)
                n = np.array([len(s) for s in sets], np.int64)
                out = np.zeros((4, len(sets)))
                d = np.zeros((2, len(sets)), np.uint64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if len(s):
                            d[0, i], d[1, i] = digest(s), tk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                            df = np.sort(sketch.value[(s >> shift).astype(np.int64)])
                            out[0, i] = np.log2(df + 1.0).mean()
                            out[1, i] = (df[: prefix_size(len(s), 1, percent)] - 1.0).sum()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, end - first) for c in ("doc_id", "text_hash")), pa.array(n), *(pa.array(x.view(np.int64)) for x in d), pa.array(out[0]), pa.array(out[1])],
                    ["doc_id", "text_hash", "n", "d1", "d2", "common", "scan"],
                )

    return run


def boundary(sizes: list[tuple[int, int, float]], percent: int = PERCENT, per_list_row: float = 0.25) -> int:
    """The largest small size, from (size, sets, sum of list lengths) of sizes up to MOST_SMALL.

    A set costs a row for each key it emits; scanning costs ``per_list_row`` for
    each row of its lists.
    """
    best, best_cost, cost = 0, 0.0, 0.0
    for n, sets, scan in sorted(sizes):
        q = prefix_size(n, 2, percent)
        cost += sets * q * (q - 1) / 2 - sets * prefix_size(n, 1, percent) - per_list_row * scan
        if cost <= best_cost:
            best, best_cost = n, cost
    return best


def _keys(sketch, k: int, percent: int, small: int):
    """(id, rep, keys, at) of every set that can have a partner: its class, the row's ``rep``, its keys; ``at`` is the key's place (from 1) in the set's order.

    For a pair of shingles it is the place of the second one less one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(math.log2(len(sketch.value))))
        border = needed(small + 1, percent)
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for first, end, raw, offs in tk.chunks(data, offsets):
                keys, places, ids = [], [], []
                for s in tk.shingle_sets(raw, offs, k):
                    n = len(s)
                    ids.append(digest(s))
                    mine, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                    if n > 1:
                        s = s[np.argsort(sketch.value[(s >> shift).astype(np.int64)], kind="stable")]  # by (count, hash)
                        if n <= small:
                            p = s[: prefix_size(n, 2, percent)]
                            i, j = np.triu_indices(len(p), 1)
                            lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                            with np.errstate(over="ignore"):
                                mine.append(tk.mix(tk.mix(lo) + hi))
                            at.append(j)
                        if n > small or n >= border:
                            mine.append(s[: prefix_size(n, 1, percent)])
                            at.append(np.arange(1, len(mine[-1]) + 1))
                    keys.append(np.concatenate(mine))
                    places.append(np.concatenate(at))
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                flat, order = pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (flat, order)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), batch.column("rep").slice(first, end - first), *lists], ["id", "rep", "keys", "at"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for first, end, raw, offs in tk.chunks(data, offsets):
                sets = tk.shingle_sets(raw, offs, k)
                cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                ids = pa.array(np.array([digest(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, batch.column("rep").slice(first, end - first), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "rep", "s"])

    return run


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, light: int = LIGHT, pivots: int = PIVOTS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; cluster names the component (null without words), text_hash the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 32 + 1))))
    sketch = spark.sparkContext.broadcast(sketch_of(docs, bits, k))
    signed = scratch.save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe(sketch, k, percent), f"doc_id {kind}, text_hash long, n long, d1 long, d2 long, common double, scan double"), "signed")
    rep = F.xxhash64("doc_id")
    classes = scratch.save(
        signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min(rep).alias("rep"), F.max("common").alias("common"), F.max("scan").alias("scan"), F.count("*").alias("copies")).withColumnRenamed("d1", "id"), "classes"
    )
    joined = classes.select("id", "n", "common").dropDuplicates(["id"])
    sizes = classes.where(f"n between 2 and {MOST_SMALL}").groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()
    small = boundary([(r["n"], r["sets"], r["scan"]) for r in sizes], percent)
    rows = docs.select(rep.alias("rep"), "text")
    repeats = bool(signed.groupBy(rep).agg(F.count("*").alias("c")).where("c > 1").limit(1).count())

    def one_each(of_rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """One row for each wanted class: of those whose ``rep`` is the class's smallest; unless a doc_id repeats, that is one."""
        found = of_rows.join(wanted.select("id", "rep"), ["id", "rep"], "left_semi").drop("rep")
        return found.dropDuplicates(["id"]) if repeats else found

    keyed = rows.mapInArrow(_keys(sketch, k, percent, small), "id long, rep long, keys array<long>, at array<int>").where(F.size("keys") > 0)
    keyed = scratch.save(one_each(keyed, classes), "keys")
    keys = keyed.select(F.explode("keys").alias("key"), "id")
    lists = scratch.save(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "lists")
    placed = keyed.select("id", F.inline(F.arrays_zip(F.col("keys").alias("key"), "at")))
    # Most keys are one set's only: a bounded map tells before the shuffle, the join exactly.
    placed = KeyMap(lists, "key").found(placed, "key")
    members = scratch.save(placed.join(lists, "key").join(joined, "id"), "members")
    scratch.drop(keyed)

    def fits(na: str, ata: str, nb: str, atb: str) -> Column:
        """Whether sets of these sizes can be similar if the shared key at these places is their first.

        Then what they share is at most that key and all after it.  Similar sets
        pass at the first key they share, so no link is lost.
        """
        a, b = F.col(na), F.col(nb)
        reach = 1 + F.least(a - F.col(ata), b - F.col(atb))
        return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (reach * (100 + percent) >= (a + b) * percent)

    few = members.where(F.col("c") <= light)
    a, b = (few.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")) for x in "ab")
    pairs = scratch.save(a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & fits("na", "ata", "nb", "atb")).select("a", "b").distinct(), "pairs")
    heavy = members.where(F.col("c") > light)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(heavy.select("id")).distinct()
    needed_rows = scratch.save(classes.join(ids, "id", "left_semi").select("id", "rep"), "wanted")
    # Texts stay where they are read; what the map lets through is shingled, and only the wanted classes' sets go on.
    texts = KeyMap(needed_rows, "rep").found(rows, "rep")
    sets = texts.mapInArrow(_sets(k), "id long, rep long, s array<long>")
    sets = scratch.save(one_each(sets, needed_rows), "sets")

    def verified(candidates: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = candidates.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        return both.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")

    links = scratch.save(verified(pairs), "links")
    labels = components(links, scratch)
    for turn in range(pivots + 1):
        now = scratch.save(heavy.join(labels, "id", "left").select("key", "id", "n", "at", "common", F.coalesce("comp", "id").alias("comp")), "labelled")
        open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("common", "comp")).alias("main")).where("lo <> hi")
        now = scratch.save(now.join(open_keys.select("key", F.col("main.comp").alias("main")), "key"), "open")
        outside = now.where(F.col("comp") != F.col("main")) if turn else now
        if not outside.limit(1).count():
            break
        if turn < pivots:
            # The commonest member, of the main component at first and then of those outside it.
            one = outside.groupBy("key").agg(F.max(F.struct("common", "id", "n", "at", "comp")).alias("p"))
            one = one.select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"), F.col("p.comp").alias("pcomp"))
        else:
            one = outside.select("key", F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("comp").alias("pcomp"))
        meet = now.join(one, "key").where((F.col("comp") != F.col("pcomp")) & fits("n", "at", "pn", "pat"))
        tried = scratch.save(meet.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct(), "tried")
        links = scratch.save(links.unionAll(verified(tried)), "links")
        labels = components(links, scratch)
    mine = scratch.save(classes.join(labels, "id", "left").select("id", "d2", "n", "doc_id", "copies", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNotNull().alias("linked")), "components")
    mine = mine.where("copies > 1 OR linked")
    least = mine.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    mine = mine.join(least, "comp").select(F.col("n").alias("n_"), F.col("id").alias("d1_"), F.col("d2").alias("d2_"), "comp", "component_id")
    out = signed.join(mine, (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")) & (F.col("n") == F.col("n_")) & (F.col("n") > 0), "left")
    cluster = F.when(F.col("n") > 0, F.coalesce("comp", "d1"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), cluster.alias("cluster"), "text_hash")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("cluster", "text_hash")


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {K} THEN list_distinct(list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i : i + {K} - 1], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id, doc_id AS root FROM sets UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
