"""Artificial holes: statistics of missing runs, and generators of masks.

A generator's ``split`` returns the table with boolean columns ``m_<column>`` for
each fold ``0 .. n_splits - 1`` (column ``fold``): masks sit on the rows they
hide.  A mask never covers a missing cell.  All choices are keyed by row, seed
and fold.
"""

from __future__ import annotations

import bisect
import json
import math
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import LacunaError, SubsetIsAString
from ..frame import Spec, no_bits, pattern
from ..functions import rand
from ..functions.ranks import ranked
from ..storage import Scratch

MASK = "m_"
#: Bytes of all masks of a fold up to which each machine gets them whole.
SMALL_MASKS = 32 << 20


def runs(df: DataFrame, column: str, spec: Spec) -> DataFrame:
    """(groups, missing, first, length): maximal runs of missing or observed cells, by the two-ranks trick."""
    w = spec.ordered("runs")
    gap = F.col(column).isNull()
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("missing", gap)
    ranked = ranked.withColumn("_island", F.col("_rn") - F.row_number().over(Window.partitionBy(*spec.groups, "missing").orderBy(*spec.order_by)))
    return ranked.groupBy(*spec.groups, "missing", "_island").agg(F.min("_rn").cast("long").alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def run_lengths(df: DataFrame, column: str, spec: Spec) -> DataFrame:
    """(length, n): the histogram of missing runs over all groups."""
    return runs(df, column, spec).where("missing").groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def state(columns: Sequence[str]) -> Column:
    return pattern(columns)


def transition_counts(df: DataFrame, columns: Sequence[str], spec: Spec) -> DataFrame:
    """(state, next, n) over consecutive rows of each group, which an all-observed row opens and closes."""
    w, none = spec.ordered("transitions"), no_bits(len(columns))
    rows = df.select(*spec.groups, *spec.order_by, state(columns).alias("state"))
    step = rows.select("state", F.coalesce(F.lead("state").over(w), none).alias("next"))
    opens = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(none.alias("state"), F.col("state").alias("next"))
    return step.unionAll(opens).groupBy("state", "next").agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(df: DataFrame, columns: Sequence[str], spec: Spec) -> DataFrame:
    """(state, next, p): counts over all groups, normalised by state."""
    counts = transition_counts(df, columns, spec)
    return counts.select("state", "next", (F.col("n") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


def sizes_max(df: DataFrame, column: str, spec: Spec) -> DataFrame:
    """Adds ``size_max``: the longest hole that may end just before a row, 0 after a missing cell and for the first."""
    w = spec.ordered("hole sizes")
    island = F.col("_rn") - F.row_number().over(Window.partitionBy(*spec.groups, "_gap").orderBy(*spec.order_by))
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_gap", F.col(column).isNull()).withColumn("_i", island)
    inside = F.row_number().over(Window.partitionBy(*spec.groups, "_gap", "_i").orderBy(*spec.order_by)) - 1
    pos = ranked.withColumn("_pos", F.when(F.col("_gap"), 0).otherwise(inside))
    return pos.withColumn("size_max", F.coalesce(F.lag("_pos").over(w), F.lit(0)).cast("long")).drop("_rn", "_gap", "_i", "_pos")


class HoleGenerator:
    """Base: ``ratio_masked`` of each subset column's cells (default: columns with holes, or all numeric) in each fold."""

    def __init__(self, n_splits: int = 1, subset: Sequence[str] | None = None, ratio_masked: float = 0.05, seed: int = 0, groups: Sequence[str] = (), order_by: Sequence[str] = (), key: Sequence[str] = ()):
        if isinstance(subset, str):
            raise SubsetIsAString(subset)
        if not 0 <= ratio_masked <= 1:
            raise LacunaError("ratio_masked lies between 0 and 1")
        self.n_splits, self.subset, self.ratio, self.seed = n_splits, subset, ratio_masked, seed
        self.spec = Spec.of(order_by, key, groups)

    def columns(self, df: DataFrame) -> list[str]:
        if self.subset is not None:
            return list(self.subset)
        free = [f.name for f in df.schema if f.name not in self.spec.reserved]
        nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in free]).first()
        return [c for c in free if nulls[c]] or free

    def rows_key(self) -> tuple[str, ...]:
        key = self.spec.key or self.spec.order_by
        if not key:
            raise LacunaError("masks are keyed by row: give key or order_by")
        return key

    def split(self, df: DataFrame) -> DataFrame:
        cols = self.columns(df)
        folds = [self.mask(df, cols, f).withColumn("fold", F.lit(f)) for f in range(self.n_splits)]
        return reduce(DataFrame.unionByName, folds)

    def mask(self, df: DataFrame, columns: list[str], fold: int) -> DataFrame:
        raise NotImplementedError


class UniformHoleGenerator(HoleGenerator):
    """Exactly ceil(ratio * rows) observed cells of each column, by the order of a keyed hash.

    ``sample_proportional`` shares the cells out by the columns' missing cells.
    The k-th smallest hash is found by counting in ranges of hashes, not by
    ranking all rows in one task.
    """

    def __init__(self, *a, sample_proportional: bool = False, **kw):
        super().__init__(*a, **kw)
        self.proportional = sample_proportional

    def mask(self, df: DataFrame, columns: list[str], fold: int) -> DataFrame:
        key = self.rows_key()
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
        n, out = row["_n"], df
        gaps = {c: n - row[c] for c in columns}
        share = {c: gaps[c] / max(sum(gaps.values()), 1) * len(columns) if self.proportional and sum(gaps.values()) else 1.0 for c in columns}
        for i, c in enumerate(columns):
            want = min(math.ceil(self.ratio * n * share[c]), row[c])
            h = F.xxhash64(F.lit(self.seed), F.lit(fold), F.lit(i), *key)
            seen = F.col(c).isNotNull()
            cut, rest = _kth(df.where(seen).select(h.alias("h")), want)
            if cut is None:
                out = out.withColumn(MASK + c, F.lit(False))
            else:
                out = out.withColumn(MASK + c, seen & ((h < cut) | ((h == cut) & F.lit(rest > 0))))
        return out


def _kth(hashes: DataFrame, k: int) -> tuple[int | None, int]:
    """The k-th smallest long of column h and how many equal to it belong, by 16 bits of the value at a time.

    Each of the four passes collects at most 65,536 counts.
    """
    if k <= 0:
        return None, 0
    value = hashes.select((F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("u"))  # order of longs as that of unsigned ones
    prefix = 0
    for level in range(3, -1, -1):
        digit = F.shiftrightunsigned("u", 16 * level).bitwiseAND(F.lit(0xFFFF))
        same = value if level == 3 else value.where(F.shiftrightunsigned("u", 16 * (level + 1)) == F.lit(prefix))
        for d, n in sorted((r["d"], r["count"]) for r in same.groupBy(digit.alias("d")).count().collect()):
            if k <= n:
                prefix = prefix << 16 | d
                break
            k -= n
        else:
            return None, 0
    return (prefix ^ (1 << 63)) - (1 << 64 if (prefix ^ (1 << 63)) >> 63 else 0), k


class GroupedHoleGenerator(HoleGenerator):
    """Whole groups are hidden, in a keyed random order, up to the group that brings the share nearest to the ratio."""

    def mask(self, df: DataFrame, columns: list[str], fold: int) -> DataFrame:
        if not self.spec.groups:
            raise LacunaError("groups are needed")
        g = self.spec.groups
        sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(F.lit(self.seed), F.lit(fold), *g))
        w = Window.orderBy("h", *g)  # over one row for each group
        run = sizes.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
        off = F.abs(F.col("upto") / F.col("total") - self.ratio)
        best = run.withColumn("best", F.min(F.struct(off, "upto")).over(Window.partitionBy())["upto"])
        chosen = best.where(F.col("upto") <= F.col("best")).select(*[F.col(c).alias(f"_g_{c}") for c in g], F.lit(True).alias("_hit"))
        out = df.join(chosen, [df[c].eqNullSafe(F.col(f"_g_{c}")) for c in g], "left")
        hit = F.coalesce("_hit", F.lit(False))
        return out.select(*df.columns, *[(hit & F.col(c).isNotNull()).alias(MASK + c) for c in columns])


def _spots(open_: bytearray, length: int, rng: np.random.Generator) -> list[int]:
    """Where ``length`` open cells begin, in random order: taking them in turn is drawing from those that still fit."""
    upto = np.r_[0, np.cumsum(np.frombuffer(open_, np.uint8), dtype=np.int64)]
    return rng.permutation(np.flatnonzero(upto[length:] - upto[:-length] == length)).tolist() if length <= len(open_) else []


def _open(free: np.ndarray) -> bytearray:
    out = bytearray(free.astype(np.uint8).tobytes())
    out[:1] = bytes(min(1, len(out)))
    return out


def _close(open_: bytearray, first: int, length: int) -> None:
    a, b = max(first - 1, 0), min(first + length + 1, len(open_))
    open_[a:b] = bytes(b - a)


def place(free: np.ndarray, lengths: Mapping[int, int], rng: np.random.Generator) -> np.ndarray:
    """A mask of runs, ``lengths`` telling how many of each length, longest first, uniformly where a free run is long enough.

    A cell apart separates runs, and the first row is left out, while there is
    room; a run that fits nowhere is halved, a single cell may then touch another.
    """
    mask, open_, todo = bytearray(len(free)), _open(free), Counter(lengths)
    while todo:
        n = max(todo)
        left = todo.pop(n)
        for a in _spots(open_, n, rng) if left else []:
            if open_.find(0, a, a + n) < 0:
                mask[a : a + n] = b"\1" * n
                _close(open_, a, n)
                left -= 1
                if not left:
                    break
        if left and n > 1:
            todo[n // 2] += left
            todo[n - n // 2] += left
        elif left:
            spare = np.flatnonzero(free & (np.frombuffer(mask, np.uint8) == 0))
            for a in rng.choice(spare, min(left, len(spare)), replace=False).tolist():
                mask[a] = 1
    return np.frombuffer(mask, np.uint8).astype(bool)


def place_states(free: np.ndarray, walks: Mapping[tuple[int, ...], int], rng: np.random.Generator) -> np.ndarray:
    """A mask by row and column of ``walks`` over states, as `place` does with runs, where all columns are free."""
    mask, whole, todo = np.zeros(free.shape, bool), free.all(axis=1), {}
    open_ = _open(whole)
    for walk, n in sorted(walks.items()):
        todo.setdefault(len(walk), []).extend([walk] * n)

    def put(a: int, walk: tuple[int, ...]) -> None:
        for i, s in enumerate(walk):
            for j in range(free.shape[1]):
                if s >> j & 1:
                    mask[a + i, j] = True

    while todo:
        n = max(todo)
        left = todo.pop(n)
        rng.shuffle(left)
        for a in _spots(open_, n, rng):
            if not left:
                break
            if open_.find(0, a, a + n) < 0:
                put(a, left.pop())
                _close(open_, a, n)
        for walk in left if n > 1 else []:
            todo.setdefault(n // 2, []).append(walk[: n // 2])
            todo.setdefault(n - n // 2, []).append(walk[n // 2 :])
        if left and n == 1:
            for a in rng.permutation(np.flatnonzero(whole & ~mask.any(axis=1))).tolist()[: len(left)]:
                put(a, left.pop())
    return mask


class _Blocks:
    """The blocks of a group's rows as holes see them: free cells, and by k the places where 2^k free cells begin."""

    def __init__(self, free: np.ndarray, fits: np.ndarray):
        self.free, self.room = free, free.tolist()
        self.upto = [np.cumsum(f) for f in fits.T if f.sum()] or [np.cumsum(free)]
        self.runs: list[Counter] = [Counter() for _ in free]

    def choose(self, lengths: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A block for each length, with the chance of its places for the next power of two."""
        k = np.minimum(np.ceil(np.log2(lengths)).astype(int), len(self.upto) - 1)
        out = np.zeros(len(lengths), int)
        for one in np.unique(k):
            at = np.flatnonzero(k == one)
            out[at] = np.searchsorted(self.upto[one], rng.integers(0, self.upto[one][-1], len(at)), "right")
        return out

    def balance(self) -> list[Counter]:
        """Lengths by block, none with more cells than are free: what is too much goes, cut if need be, where there is room."""
        extra: list[int] = []
        for b, runs in enumerate(self.runs):
            self.room[b] -= sum(n * k for n, k in runs.items())
            for n in sorted(runs):
                k = min(runs[n], -(-max(-self.room[b], 0) // n))
                runs[n] -= k
                self.room[b] += n * k
                extra += [n] * int(k)
        b = 0
        for n in extra:
            while n and b < len(self.room):
                here = int(min(n, self.room[b]))
                if here:
                    self.runs[b][here] += 1
                self.room[b] -= here
                n -= here
                b += not self.room[b]
        return [+runs for runs in self.runs]


class _Placed(HoleGenerator):
    """Holes are drawn by group from its blocks' counts, and placed in blocks of rows, each in a task.

    A block holds ``block_rows`` rows, and more where holes are long; a group of
    fewer rows is one block.  Rows stay in Spark; a task sees which cells of a
    block are free.  The first row of a block is left out like that of a group.
    """

    def __init__(self, *a, block_rows: int = 65_536, **kw):
        super().__init__(*a, **kw)
        self.block_rows = block_rows

    def learn(self, df: DataFrame, columns: list[str]) -> dict[str, object]:
        """What holes are drawn from, by layer: a column, or all columns as one."""
        raise NotImplementedError

    def longest(self, model: object, columns: list[str]) -> int:
        """Rows of the longest of a thousand holes."""
        raise NotImplementedError

    def deal(self, model: object, n: int, cells: int, blocks: _Blocks, rng: np.random.Generator) -> list[Counter]:
        """The holes of each block, of a group of ``n`` rows and ``cells`` cells a row."""
        raise NotImplementedError

    def layers(self, free: np.ndarray) -> list[np.ndarray]:
        """The cells that each layer's holes may take."""
        return list(free.T)

    def put(self, free: np.ndarray, holes: list[Counter], fold: int, columns: list[str], *of: object) -> np.ndarray:
        raise NotImplementedError

    def split(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [m.withColumn("fold", F.lit(f)) for f, m in self.masks(df, self.columns(df), range(self.n_splits)).items()])

    def mask(self, df: DataFrame, columns: list[str], fold: int) -> DataFrame:
        return self.masks(df, columns, [fold])[fold]

    def masks(self, df: DataFrame, columns: list[str], folds: Sequence[int]) -> dict[int, DataFrame]:
        self.spec.ordered("placing holes")
        spec, seed, d, deal, layers, put = self.spec, self.seed, len(columns), self.deal, self.layers, self.put
        scratch = Scratch(df.sparkSession)
        models = self.learn(df, columns)
        names = list(models)
        size = 64 * -(-max(self.block_rows, 64 * max([self.longest(m, columns) for m in models.values()], default=1)) // 64)
        group = F.to_json(F.struct(*spec.groups), {"ignoreNullFields": "false"}) if spec.groups else F.lit("")
        order = F.struct(*dict.fromkeys([*spec.order_by, *spec.key]))
        rows = ranked(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), group.alias("g"), order.alias("o")), "g", "o", scratch)
        placed = scratch.save(rows.select("row", "g", F.expr(f"i div {size}").cast("int").alias("b"), F.expr(f"i % {size}").cast("int").alias("at")), "placed")

        def pack(key, pdf):
            free = pdf.sort_values("at")[seen].to_numpy(bool)
            of, fits = layers(free), []
            for one in of:
                upto = np.r_[0, np.cumsum(np.frombuffer(_open(one), np.uint8), dtype=np.int64)]
                fits += [int((upto[n:] - upto[:-n] == n).sum()) if n < len(upto) else 0 for n in powers]
            return pd.DataFrame({"g": [key[0]], "b": int(key[1]), "n": len(free), "free": [[int(one.sum()) for one in of]], "fits": [fits], "bits": [np.packbits(free).tobytes()]})

        seen, powers = [f"s{j}" for j in range(d)], [1 << k for k in range(size.bit_length())]
        flags = placed.select("g", "b", "at", *[F.col("row")[c].isNotNull().alias(s) for c, s in zip(columns, seen)])
        packed = scratch.save(flags.groupBy("g", "b").applyInPandas(pack, "g string, b int, n int, free array<long>, fits array<long>, bits binary"), "blocks")

        def draw(key, pdf):
            pdf, out = pdf.sort_values("b"), []
            free, fits = np.stack(pdf["free"]), np.stack(pdf["fits"]).reshape(len(pdf), len(names), -1)
            for f in folds:
                dealt = [deal(models[m], int(pdf["n"].sum()), d, _Blocks(free[:, i], fits[:, i]), rand.generator(seed, f, m, key[0])) for i, m in enumerate(names)]
                out += [(key[0], int(b), f, json.dumps([list(one[k].items()) for one in dealt])) for k, b in enumerate(pdf["b"])]
            return pd.DataFrame(out, columns=["g", "b", "fold", "holes"])

        drawn = packed.select("g", "b", "n", "free", "fits").groupBy("g").applyInPandas(draw, "g string, b int, fold int, holes string")

        def run(batches):
            for pdf in batches:
                out = []
                for g, b, n, bits, fold, holes in zip(*(pdf[c] for c in ("g", "b", "n", "bits", "fold", "holes"))):
                    free = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * d).reshape(n, d).astype(bool)
                    mask = put(free, [Counter({tuple(h) if isinstance(h, list) else h: k for h, k in one}) for one in json.loads(holes)], fold, names, g, b) & free
                    words = np.zeros((d, -(-n // 64) * 64), bool)
                    words[:, :n] = mask.T
                    out.append((g, b, fold, *np.packbits(words, axis=1, bitorder="little").view("<i8")))
                yield pd.DataFrame(out, columns=["g", "b", "fold", *words_of])

        words_of = [f"w{j}" for j in range(d)]
        met = packed.select("g", "b", "n", "bits").join(drawn, ["g", "b"])
        masks = scratch.save(met.mapInPandas(run, ", ".join(["g string, b int, fold int", *[f"{w} array<long>" for w in words_of]])), "masks")
        total = packed.agg(F.sum("n")).first()[0] or 0
        small = total * d <= 8 * SMALL_MASKS
        hit = [F.expr(f"shiftright({w}[at div 64], cast(at % 64 as int)) & 1 = 1").alias(MASK + c) for w, c in zip(words_of, columns)]
        one = {f: masks.where(F.col("fold") == f).drop("fold") for f in folds}
        return {f: placed.join(F.broadcast(m) if small else m, ["g", "b"]).select(*[F.col("row")[c].alias(c) for c in df.columns], *hit) for f, m in one.items()}


class _Sampled(_Placed):
    """Runs whose lengths are drawn, for each column on its own."""

    def draws(self, model: object, n: int, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def longest(self, model: object, columns: list[str]) -> int:
        return int(self.draws(model, 1000, rand.generator("longest")).max())

    def deal(self, model, n, cells, blocks, rng):
        """Lengths that sum up to the ratio of the rows, if so many cells are free: the last one is cut to fit."""
        left = min(round(self.ratio * n), int(blocks.free.sum()))
        while left > 0:
            lengths = np.clip(self.draws(model, min(left, 4096), rng), 1, left)
            upto = np.cumsum(lengths)
            lengths = lengths[: np.searchsorted(upto, left) + 1]
            lengths[-1] -= max(0, int(lengths.sum()) - left)
            left -= int(lengths.sum())
            for one, b in zip(lengths.tolist(), blocks.choose(lengths, rng).tolist()):
                blocks.runs[b][one] += 1
        return blocks.balance()

    def put(self, free, holes, fold, columns, *of):
        return np.stack([place(free[:, j], holes[j], rand.generator(self.seed, fold, c, *of)) for j, c in enumerate(columns)], axis=1)


class GeometricHoleGenerator(_Sampled):
    """Lengths of a two-state Markov chain: geometric with the chance that a missing cell is followed by an observed one."""

    def learn(self, df: DataFrame, columns: list[str]) -> dict[str, float]:
        out = {}
        for c in columns:
            p = {(r["state"], r["next"]): r["p"] for r in transition_matrix(df, [c], self.spec).collect()}
            out[c] = p.get((1, 0), 1.0)
        return out

    def draws(self, model: float, n: int, rng: np.random.Generator) -> np.ndarray:
        return rng.geometric(min(max(model, 1e-9), 1.0), n)


class EmpiricalHoleGenerator(_Sampled):
    """Lengths drawn from those seen, over all groups; 1 where there are none."""

    def learn(self, df: DataFrame, columns: list[str]) -> dict[str, list[tuple[int, int]]]:
        return {c: sorted((r["length"], r["n"]) for r in run_lengths(df, c, self.spec).collect()) for c in columns}

    def draws(self, model: list[tuple[int, int]], n: int, rng: np.random.Generator) -> np.ndarray:
        lengths, seen = np.array(model or [(1, 1)]).T
        return rng.choice(lengths, n, p=seen / seen.sum())


class MultiMarkovHoleGenerator(_Placed):
    """One chain over the pattern of all columns; its excursions from the all-observed state are placed as blocks, longest first."""

    def learn(self, df: DataFrame, columns: list[str]) -> dict[str, dict[int, tuple[list[int], list[float]]]]:
        chain: dict[int, list[tuple[int, float]]] = {}
        number = lambda s: int(s[::-1], 2) if isinstance(s, str) else int(s)
        for r in transition_matrix(df, columns, self.spec).collect():
            chain.setdefault(number(r["state"]), []).append((number(r["next"]), r["p"]))
        chain[0] = [(s, p) for s, p in chain.get(0, []) if s]
        return {"": {s: ([n for n, _ in sorted(to)], np.cumsum([p for _, p in sorted(to)]).tolist()) for s, to in chain.items()}}

    def layers(self, free: np.ndarray) -> list[np.ndarray]:
        return [free.all(axis=1)]

    def longest(self, model, columns: list[str]) -> int:
        rng = rand.generator("longest")
        return max(len(self.excursion(model, len(columns), 1 << 20, rng)) for _ in range(1000))

    @staticmethod
    def excursion(chain, cells: int, most: int, rng: np.random.Generator) -> list[int]:
        def after(s: int) -> int:
            to, upto = chain.get(s, ([0], [1.0]))
            return to[min(bisect.bisect_right(upto, rng.random() * upto[-1]), len(to) - 1)]

        if not chain[0][0]:
            return [1 << int(rng.integers(cells))]
        s, out = after(0), []
        while s and len(out) < most:
            out.append(s)
            s = after(s)
        return out

    def deal(self, model, n, cells, blocks, rng):
        """Excursions until the ratio of all cells is met; the last one is cut to fit."""
        left, most = round(self.ratio * n * cells), max(1, n // 4)
        while left > 0:
            walks = []
            while left > 0 and len(walks) < 4096:
                walk = self.excursion(model, cells, most, rng)
                left -= sum(s.bit_count() for s in walk)
                while left < 0:
                    last = walk.pop()
                    while left < 0 and last:
                        last &= last - 1
                        left += 1
                    walk += [last] if last else []
                walks.append(tuple(walk))
            for walk, b in zip(walks, blocks.choose(np.array([len(w) for w in walks]), rng).tolist()):
                blocks.runs[b][walk] += 1
        return blocks.runs

    def put(self, free, holes, fold, columns, *of):
        return place_states(free, holes[0], rand.generator(self.seed, fold, *of))


class _FixedGeometric(GeometricHoleGenerator):
    def __init__(self, mean_size: float, **kw):
        super().__init__(**kw)
        self.mean_size = mean_size

    def learn(self, df: DataFrame, columns: list[str]) -> dict[str, float]:
        return {c: 1.0 / self.mean_size for c in columns}


def hide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells under their mask become NULL."""
    return df.select(*[F.when(~F.col(MASK + c), F.col(c)).alias(c) if c in set(columns) else F.col(c) for c in df.columns])


def add_holes(df: DataFrame, ratio_masked: float, mean_size: float, columns: Sequence[str], order_by: Sequence[str], groups: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Hides runs of geometric length with a given mean in complete data."""
    gen = _FixedGeometric(mean_size, subset=list(columns), ratio_masked=ratio_masked, order_by=order_by, groups=groups, seed=seed)
    return hide(gen.mask(df, list(columns), 0), columns).drop(*[MASK + c for c in columns])
