"""Line dedup by a segment-partition edit join, in DataFrame functions only.

All lines of at least ``exact_bytes`` UTF-8 bytes are compared for equality, which
is all but empty ones by default; those of at least ``least_bytes`` also for being
near.  (Two edits in a shorter line make another line: another number, another
word.)  An occurrence is removed when an equal line, or a line within
``threshold`` byte edits (insert, delete, replace), occurs first at an earlier
place; places are ordered by (doc_id, text, line number).  A line near an earlier line goes whether or not
that one stays.

Candidates.  A line of length l is split into threshold + 1 even segments; two
lines within the threshold share one of them exactly, at a place that shifts by
no more than the edits allow on either side.  So each line indexes its segments
by (length, number, bytes), and probes, for each length from its own down to
``threshold`` less, the substrings that the multi-match-aware windows admit: 9
besides its own for a threshold of 2.

1. The keys of all segments are aggregated to the least and largest line hash of
   each: a key of two lines is shared.
2. Probes are looked up, where they are made, in a bit map of these keys (at most
   16 MB; with very large inputs it lets more rows pass, and stays right); those
   found meet the keys' rows exactly.
3. Keys shared so far are few.  Only lines that hold one become candidates: one
   row for each text, with its first place, its keys, and a signature, the counts
   of 32 frequent bytes.  Most lines are in none and cost no more than their keys.

Pairs.  A line goes if any line of its lists is earlier and near, so one witness is
enough.  Lists of at most ``light`` lines give all pairs whose signatures admit
them.  In longer ones the earliest line that is still open is compared with all
others, which decides the later of each two that are near; then the next open
one, ``rounds`` times; what is then still open meets the earlier lines of its
lists.  So a list of lines that are near each other costs its length and not its
square.

Verification.  A pair first needs most of the pieces of one line in the other, near
their places, which rejects nearly all others.  Then common prefixes and suffixes are cut off by bisection on native
comparisons; over what is left runs a bit-parallel automaton: for each number of
edits one word whose bits are the 2 * threshold + 1 diagonals of the band.

Removal.  Lines that occur once and are near no other are left out by a bit map
before places are collected.  The first places of very common lines (over 1/512 of
all, so at most 512) are broadcast; the others are shuffled by line.  Texts move
only for documents that may lose lines.

Defined cases: a null text has no line and stays null; an empty text has one
line, the empty one, which is never compared.  Lines end at "\\n" only.  A
null doc_id comes first.  Rows with equal doc_id are told apart by their text;
rows equal in both count as the same place, and their lines stay or go together.
Documents are never removed: one that loses every line has an empty text.  Extra
columns are kept as they are, whatever their names; only ``n_lines`` and
``n_removed`` of the input give way to the new ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyMap, Scratch, table

THRESHOLD = 2
LEAST_BYTES = 32
EXACT_BYTES = 1
LIGHT = 64
ROUNDS = 2
#: A line on more than one of so many of all lines is very common.
COMMON = 512
#: Frequent bytes of many scripts' texts; any choice is right, these tell lines apart well.
SIGNATURE = " etaniorshldcumfpgwybvk102345678"


def signature(line: Column) -> Column:
    """Counts modulo 4 of 32 bytes, two bits each in Gray code: a count that moves by one turns one bit."""

    def add(word: Column, c: Column) -> Column:
        count = (F.octet_length(line) - F.octet_length(F.replace(line, c, F.lit("")))).bitwiseAND(F.lit(3))
        return F.shiftleft(word, 2).bitwiseOR(count.bitwiseXOR(F.shiftright(count, 1)).cast("long"))

    return F.aggregate(F.array(*map(F.lit, SIGNATURE)), F.lit(0).cast("long"), add)


def near_signature(a: Column, b: Column, threshold: int) -> Column:
    """Whether two signatures may belong to lines within the threshold: an edit moves two counts by one at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * threshold


def windows(threshold: int, own: bool, probes: bool) -> Column:
    """Where a line's keys are: (less, part, shift) for segment ``part`` (from 1) of a line ``less`` bytes shorter, moved by ``shift``."""
    found = []
    for less in range(threshold + 1):
        for i in range(1, threshold + 2):
            low, high = max(-(i - 1), less - (threshold + 1 - i)), min(i - 1, less + (threshold + 1 - i))
            found += [(less, i, shift) for shift in range(low, high + 1) if (probes if less or shift else own)]
    return F.array(*[F.struct(F.lit(x).alias("less"), F.lit(i).alias("part"), F.lit(y).alias("shift")) for x, i, y in found])


def keyed(lines: DataFrame, threshold: int, least: int, own: bool, probes: bool) -> DataFrame:
    """``lines`` once for each key, with ``key`` (null where its window does not fit) and ``own``, 1 for the line's own segments.

    A segment has floor(length / (threshold + 1)) bytes, the last ones take the
    remainder's.  The windows are rows, not columns: so the code of one step stays
    small enough for the JVM to compile it.
    """
    k = threshold + 1
    part, shift = F.col("part"), F.col("shift")
    rows = lines.select("*", F.octet_length("line").alias("bytes"), F.inline(windows(threshold, own, probes)))
    rows = rows.select("*", (F.col("bytes") - F.col("less")).alias("length"))
    rows = rows.select("*", F.expr(f"length div {k}").cast("int").alias("size"))
    longer = F.col("length") - F.col("size") * k
    rows = rows.select("*", (1 + F.col("size") * (part - 1) + F.greatest(longer - (k - part + 1), F.lit(0)) + shift).alias("at"), (F.col("size") + (part > k - longer).cast("int")).alias("width"))
    fits = (F.col("at") >= 1) & (F.col("at") + F.col("width") - 1 <= F.col("bytes")) & (F.col("length") >= least)
    key = F.when(fits, F.xxhash64("part", "length", F.substring(F.col("line").cast("binary"), F.col("at"), F.col("width"))))
    own_one = ((F.col("less") == 0) & (shift == 0)).cast("int")
    return rows.select(*lines.columns, key.alias("key"), own_one.alias("own"))


def held(rows: DataFrame, some: KeyMap) -> DataFrame:
    """The rows whose key the map may hold; the key is computed once."""
    others = [c for c in rows.columns if c != "key"]
    return rows.select(*others, F.explode(F.array(F.when(some.has(F.col("key")), F.col("key")))).alias("key")).where("key IS NOT NULL")


def common_prefix(a: Column, b: Column, most: Column, cut) -> Column:
    """Length of the common prefix, at most ``most``; ``cut(x, k)`` gives the first k bytes."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= most) & (cut(a, k + s) == cut(b, k + s)), k + s).otherwise(k))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two short binaries are within ``threshold`` edits.

    Bit o of word d is set after j bytes of ``b`` when the first j + o -
    threshold bytes of ``a`` can be turned into them with at most d edits.  A
    byte outside UTF-8 fills ``a`` on both sides, so that it never matches.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    fill = F.lit(b"\xff" * t)
    padded = F.concat(fill, a, fill) if t else a
    start = F.struct(*[F.lit(sum(1 << o for o in range(t, t + d + 1)) & full).alias(f"r{d}") for d in range(t + 1)])

    def step(state: Column, j: Column) -> Column:
        c = F.substring(b, j, F.lit(1))
        equal = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.substring(padded, j + o, F.lit(1)) == c, 1 << o).otherwise(0) for o in range(width)])
        new = [state["r0"].bitwiseAND(equal)]
        for d in range(1, t + 1):
            before = state[f"r{d - 1}"]
            reach = state[f"r{d}"].bitwiseAND(equal).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[d - 1], 1))
            new.append(reach.bitwiseAND(F.lit(full)))
        return F.struct(*[x.alias(f"r{d}") for d, x in enumerate(new)])

    m, n = F.octet_length(a), F.octet_length(b)
    last = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step)
    return (F.abs(m - n) <= t) & (F.call_function("shiftright", last[f"r{t}"], m - n + t).bitwiseAND(F.lit(1)) == 1)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.

    A filter or projection above is not pushed through a generator, so it reads
    the values and does not repeat their expressions, as it would for
    ``withColumn``.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def pieces_agree(a: Column, b: Column, threshold: int) -> Column:
    """Whether enough of 4 * threshold pieces of ``a`` stand in ``b``, moved by the threshold at most.

    An edit spoils one piece and moves what follows by one; so lines that fail
    have more edits.  Pieces are of characters, which no fewer byte edits spoil.
    """
    if not threshold:
        return a == b
    t, m, n = threshold, 4 * threshold, F.length(a)

    def add(found: Column, j: Column) -> Column:
        start, end = F.floor(n * j / m).cast("int"), F.floor(n * (j + 1) / m).cast("int")
        low = F.greatest(start - t, F.lit(0))
        return found + (F.call_function("instr", F.substring(b, low + 1, end + t - low), F.substring(a, start + 1, end - start)) > 0).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.lit(0), add) >= m - t


def edit_within(a: str, b: str, threshold: int, pairs: DataFrame) -> DataFrame:
    """The pairs whose string columns ``a`` and ``b`` are within ``threshold`` byte edits."""
    pairs = pairs.where(pieces_agree(F.col(a), F.col(b), threshold))
    pairs = pairs.withColumns({a: F.col(a).cast("binary"), b: F.col(b).cast("binary")})
    head = lambda x, k: F.substring(x, F.lit(1), k)
    tail = lambda x, k: F.substring(x, F.octet_length(x) - k + 1, k)
    p = pinned(pairs, _p=common_prefix(F.col(a), F.col(b), F.least(F.octet_length(a), F.octet_length(b)), head))
    rest = lambda c: F.substring(c, F.col("_p") + 1, F.octet_length(c))
    p = pinned(p, _a=rest(F.col(a)), _b=rest(F.col(b)))
    p = pinned(p, _s=common_prefix(F.col("_a"), F.col("_b"), F.least(F.octet_length("_a"), F.octet_length("_b")), tail))
    short = lambda c: F.substring(F.col(c), F.lit(1), F.octet_length(c) - F.col("_s"))
    p = pinned(p, _c=short("_a"), _d=short("_b"))
    p = pinned(p, _near=within(F.col("_c"), F.col("_d"), threshold))
    return p.where("_near").drop("_a", "_b", "_c", "_d", "_p", "_s", "_near")


def lines_of(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, th, pos, line): all lines of some length with their places; th is the text's hash."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.octet_length("line") >= max(1, least))


def candidates(docs: DataFrame, threshold: int, least: int, scratch: Scratch) -> DataFrame:
    """(first, line, n, sig, hits) of each line that shares a key with another; hits are (key, own)."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.octet_length("line") >= least).select("line", F.xxhash64("line").alias("h"))
    index = keyed(lines, threshold, least, True, False).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    index = scratch.save(index, "index")
    shared = index.where("lo <> hi").select("key")
    if threshold:
        probes = held(keyed(lines, threshold, least, False, True), KeyMap(index, "key"))
        asked = scratch.save(probes.groupBy("key").agg(F.min("h").alias("plo"), F.max("h").alias("phi")), "probes")
        met = KeyMap(asked, "key").found(index, "key").join(asked, "key").where("lo <> hi OR plo <> phi OR lo <> plo").select("key")
        shared = shared.unionAll(met)
    some = KeyMap(scratch.save(shared.distinct(), "shared"), "key")
    scratch.drop(index)
    hits = held(keyed(lines_of(docs, least), threshold, least, True, True), some)
    texts = hits.groupBy("line").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.collect_set(F.struct("key", "own")).alias("hits"))
    return scratch.save(texts.select("first", "line", F.octet_length("line").alias("n"), signature(F.col("line")).alias("sig"), "hits"), "candidates")


def near_lines(docs: DataFrame, threshold: int, least: int, scratch: Scratch, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """(first): the first places of lines that are near an earlier line."""
    texts = candidates(docs, threshold, least, scratch)
    members = texts.select("first", "n", "sig", F.inline("hits"))
    counts = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.save(members.join(counts, "key"), "members")
    at = F.col

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("key", *[at(c).alias(f"{x}_{c}") for c in ("first", "own", "n", "sig")])

    def meet(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
        """(a, b): pairs of a list that may be near, the earlier one first; at least one of them indexes the key."""
        sig = near_signature(at("a_sig"), at("b_sig"), threshold)
        both = side(a, "a").join(side(b, "b"), "key").where(condition & ((at("a_own") + at("b_own")) >= 1) & (F.abs(at("a_n") - at("b_n")) <= threshold) & sig)
        return both.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(pairs.distinct(), "pairs")
        a, b = (texts.select(at("first").alias(x), at("line").alias(f"{x}_line")) for x in "ab")
        return scratch.save(edit_within("a_line", "b_line", threshold, pairs.join(a, "a").join(b, "b")).select(at("b").alias("first")).distinct(), name)

    few, many = members.where(at("c") <= light), members.where(at("c") > light)
    near = verified(meet(few, few, at("a_first") < at("b_first")), "near")
    last = None
    for turn in range(rounds + 1):
        undecided = many.join(near, "first", "left_anti")
        if not undecided.limit(1).count():
            break
        if turn < rounds:
            free = undecided.where("own = 1")
            if last is not None:
                free = free.join(last, "key").where(at("first") > at("last")).drop("last")
            pivot = free.groupBy("key").agg(F.min(F.struct("first", "own", "n", "sig")).alias("p"))
            pivot = scratch.save(pivot.select("key", "p.*"), "pivot")
            pairs = meet(pivot, many, at("a_first") != at("b_first")).join(near.select(at("first").alias("b")), "b", "left_anti")
            last = pivot.select("key", at("first").alias("last"))
        else:
            pairs = meet(many, undecided, at("a_first") < at("b_first"))
        near = scratch.save(near.unionAll(verified(pairs, "turn")).distinct(), "near")
    return near


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, least_bytes: int = LEAST_BYTES, scratch: Scratch | None = None, exact_bytes: int = EXACT_BYTES, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, drop): for each place of a document the positions of lines to remove."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    near = near_lines(docs, threshold, max(least_bytes, threshold + 1), scratch, light, rounds)
    # Two hashes name a line; only lines that repeat, or are near another, go on.
    short = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.octet_length("line") >= max(1, min(exact_bytes, least_bytes)))
    repeated = short.select(F.xxhash64("line").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    near = scratch.save(near.select("first", F.lit(True).alias("is_near")), "is_near")
    hashed = lines_of(docs, min(exact_bytes, least_bytes)).select(F.struct("doc_id", "th", "pos").alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    at_first = KeyMap(near.select(F.xxhash64("first").alias("k")), "k")
    twice = KeyMap(scratch.save(repeated, "repeated"), "h")
    known = scratch.save(hashed.where(twice.has(F.col("h")) | at_first.has(F.xxhash64("place"))), "known")
    firsts = known.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    guilty = scratch.save(firsts.join(near, "first", "left").where((F.col("c") > 1) | F.col("is_near")), "guilty")
    common = guilty.where(F.col("c") > max(1, known.count() // COMMON)).select(F.col("h"), F.col("g"), "first", "is_near")
    others = guilty.join(common.select("h", "g"), ["h", "g"], "left_anti").select("h", "g", "first", "is_near")
    hot = known.join(F.broadcast(common), ["h", "g"])
    rest = known.join(F.broadcast(common.select("h", "g")), ["h", "g"], "left_anti").join(others, ["h", "g"])
    gone = hot.unionAll(rest).where(F.col("is_near") | (F.col("place") != F.col("first")))
    return scratch.save(gone.select("place.*").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")), "drop")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least_bytes: int = LEAST_BYTES, exact_bytes: int = EXACT_BYTES, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; n_lines and n_removed are added."""
    gone = removed_lines(docs, threshold, least_bytes, None, exact_bytes, light, rounds)
    gone = gone.select(F.struct("doc_id", "th").alias("at"), "drop")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    at = lambda c: F.xxhash64(f"{c}.doc_id", f"{c}.th")
    # The row is one column, so that no name of its own meets another.
    rows = docs.select(F.struct(*names).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("th")).alias("place"))
    maybe = KeyMap(gone.select(at("at").alias("k")), "k").has(at("place"))
    lines = F.split("row.text", "\n", -1)
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    # Documents that lose nothing stay where they are; only the others meet their list of lines.
    whole = rows.where(~maybe).select("row.*", n_lines, F.lit(0).cast("long").alias("n_removed"))
    some = rows.where(maybe).join(gone, F.col("place") == F.col("at"), "left")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    removed = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed")
    return whole.unionAll(some.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in names], n_lines, removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
),
firsts AS (
  SELECT line, min((doc_id, pos)) AS place, strlen(line) AS n FROM lines WHERE strlen(line) >= {EXACT_BYTES} GROUP BY line
),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
  ON a.n >= {LEAST_BYTES} AND b.n >= {LEAST_BYTES} AND a.n BETWEEN b.n - {THRESHOLD} AND b.n + {THRESHOLD} AND a.place < b.place AND levenshtein(a.line, b.line) <= {THRESHOLD}
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.place OR l.line IN (FROM near)) AS gone
  FROM lines l LEFT JOIN firsts f ON f.line = l.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256
FROM marked GROUP BY doc_id
"""
