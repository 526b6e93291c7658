"""Are values missing completely at random?  Little's test and the PKLM test."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LacunaError, TypeNotHandled
from ..frame import about_means, bit_set, canonical, numeric_columns, pattern
from ..functions import rand, select, special
from ..functions.ranks import ranked
from ..storage import Scratch
from .em import WIDE, gaussian_em, gaussian_em_rows, pattern_moments, unpack
from .forest import LINES, Forest, draws


@dataclass(frozen=True)
class LittleTest:
    """Means of missingness patterns against the Gaussian maximum-likelihood mean: a chi-squared statistic.

    One aggregate over the rows; the rest is algebra on one row for each pattern.
    Beyond ``em.WIDE`` columns patterns may be as many as rows: EM passes over the rows
    then, and each pattern's term is computed where its sums are.
    """

    columns: Sequence[str] | None = None
    max_iter: int = 500
    tolerance: float = 1e-8

    def statistic(self, df: DataFrame) -> tuple[float, int]:
        cols = list(self.columns or numeric_columns(df))
        d = len(cols)
        about, _ = about_means(canonical(df, cols), cols)
        if d > WIDE:
            return self._wide(Scratch(df.sparkSession).save(about.select(*cols), "rows", tidy=False), d)
        rows = [r.asDict() for r in pattern_moments(about, cols).collect()]
        mu, sigma, _ = gaussian_em(rows, d, self.max_iter, self.tolerance)
        n = sum(r["n"] for r in rows)
        sigma, d2, free = sigma * n / (n - 1), 0.0, 0
        for r in rows:
            o, m, s, _ = unpack(r, d)
            if len(o):
                gap = s / m - mu[o]
                d2 += m * float(gap @ np.linalg.pinv(sigma[np.ix_(o, o)]) @ gap)
                free += len(o)
        return d2, free - d

    def _wide(self, rows: DataFrame, d: int) -> tuple[float, int]:
        mu, sigma, _ = gaussian_em_rows(rows, d, self.max_iter, self.tolerance)
        n = rows.count()
        sigma = sigma * n / (n - 1)
        sums = rows.groupBy(pattern(rows.columns).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in rows.columns]).alias("s"))

        def run(batches):
            for pdf in batches:
                d2, free = 0.0, 0
                for p, m, s in zip(pdf["p"], pdf["n"], pdf["s"]):
                    o = np.array([i for i in range(d) if not bit_set(p, i)], int)
                    if len(o):
                        gap = np.array(s, float)[o] / m - mu[o]
                        d2 += m * float(gap @ np.linalg.pinv(sigma[np.ix_(o, o)]) @ gap)
                        free += len(o)
                yield pd.DataFrame({"d2": [d2], "free": [free]})

        got = sums.mapInPandas(run, "d2 double, free long").agg(F.sum("d2"), F.sum("free")).first()
        return got[0] or 0.0, (got[1] or 0) - d

    def test(self, df: DataFrame) -> float:
        """The p-value."""
        d2, free = self.statistic(df)
        return special.chi2_sf(d2, free) if free > 0 else 1.0


def encode(df: DataFrame) -> DataFrame:
    """Numbers as double; strings and booleans as one 0/1 column for each value, NULL kept."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            values = sorted(r[0] for r in df.select(f.name).where(F.col(f.name).isNotNull()).distinct().collect())
            out += [(F.col(f.name) == v).cast("double").alias(f"{f.name}_{v}") for v in values]
        else:
            raise TypeNotHandled(f.name, f.dataType.simpleString())
    return df.select(*out)


def most_draws(p: int) -> int:
    return p * (2 ** (p - 1) - 1)


def u_hat(p: np.ndarray, y: np.ndarray) -> float:
    """Mean log-odds of being missing among the missing less that among the observed."""
    a, n, b, m = _odds_sums(p, y)
    return a / n - b / m


def _odds_sums(p: np.ndarray, y: np.ndarray) -> tuple[float, int, float, int]:
    """Sums of log-odds and numbers of rows, of the missing and of the observed."""
    q = np.clip(p, 1e-9, 1 - 1e-9)
    odds = np.log(q / (1 - q))
    return float(odds[y == 1].sum()), int((y == 1).sum()), float(odds[y == 0].sum()), int((y == 0).sum())


#: A missing cell among the bin codes.
HOLE = 255


def _cut_ranks(n: int, bins: int) -> list[int]:
    """Places in order of the values that end a bin, of ``n`` values."""
    return sorted({n * k // bins for k in range(1, bins)}) if n else []


def cut_points(rows: DataFrame, bins: int, block_rows: int) -> tuple[int, dict[str, list[float]]]:
    """Rows, and by column the values that end a bin: all but the largest where these are fewer than ``bins``, else even ranks.

    Columns of few values are told by a sketch of distinct counts, which does not depend
    on the partitioning; cuts come from exact order statistics by counting, whose driver
    side is bins x columns numbers.  A table of one block is sorted in its one task later,
    with the same cuts, so nothing is asked here but its size.
    """
    names = rows.columns
    n = rows.count()
    if n <= block_rows:
        return n, {}
    seen = rows.agg(*[f(F.col(f"`{c}`")) for c in names for f in (F.count, F.approx_count_distinct)]).first()
    cuts: dict[str, list[float]] = {}
    for k, c in enumerate(names):
        if seen[2 * k + 1] <= 2 * bins:
            values = sorted(r[0] for r in rows.select(F.col(f"`{c}`").alias("v")).where("v IS NOT NULL").distinct().limit(4 * bins).collect())
            if len(values) <= bins:
                cuts[c] = values[:-1]
    ranks = {c: _cut_ranks(seen[2 * k], bins) for k, c in enumerate(names) if c not in cuts}
    return n, cuts | {c: sorted(set(v)) for c, v in select.order_statistics(rows, ranks).items()}


def _block_cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """The cuts of ``cut_points`` from all known values of a column."""
    v = np.sort(v + 0.0)
    seen = np.unique(v)
    return seen[:-1] if len(seen) <= bins else np.unique(v[_cut_ranks(len(v), bins)])


def coded_blocks(coded: DataFrame, scratch: Scratch, bins: int, block_rows: int) -> DataFrame:
    """Stored blocks (block, place array, codes: bytes by column) of at most ``block_rows`` rows each.

    Rows take their place in the order of a hash of their cells, so neither the order
    nor the partitioning of the input matters; equal rows are interchangeable.  Blocks
    deal the places out in turn, so each is like the whole table.
    """
    names = [f"c{i}" for i in range(len(coded.columns))]
    # Cuts and places take some passes; what made the rows is done once.
    rows = scratch.save(coded.toDF(*names), "rows", tidy=False)
    n, cuts = cut_points(rows, bins, block_rows)
    schema = "block int, place binary, codes array<binary>"

    def packed(block: int, place: np.ndarray, values: pd.DataFrame) -> pd.DataFrame:
        codes = []
        for c in names:
            v = values[c].to_numpy(float, na_value=np.nan)
            known = ~np.isnan(v)
            at = np.full(len(v), HOLE, np.uint8)
            at[known] = np.searchsorted(cuts[c] if cuts else _block_cuts(v[known], bins), v[known], side="left")
            codes.append(at.tobytes())
        return pd.DataFrame({"block": [block], "place": [place.astype(np.int64).tobytes()], "codes": [codes]})

    # Hashes skip NULL, so the flags tell rows apart that hold the same numbers in other columns.
    hashed = rows.withColumn("h", F.xxhash64(*names, *[F.col(c).isNull() for c in names]))
    if n <= block_rows:
        def one(batches):
            got = list(batches)
            if got:
                pdf = pd.concat(got).sort_values(["h", *names], kind="stable")
                yield packed(0, np.arange(len(pdf)), pdf)

        return scratch.save(hashed.coalesce(1).mapInPandas(one, schema), "blocks", tidy=False)
    n_blocks = -(-n // block_rows)
    # Equal rows, which may be a third of all, spread over ranges by the salt.
    placed = ranked(hashed.select(F.lit(0).alias("g"), F.struct("h", *names, F.rand(0).alias("salt")).alias("o")), "g", "o", scratch)
    placed = placed.select("i", (F.col("i") % n_blocks).cast("int").alias("block"), *[f"o.{c}" for c in names])

    def one_block(key, pdf):
        pdf = pdf.sort_values("i")
        return packed(int(key[0]), pdf["i"].to_numpy(), pdf)

    return scratch.save(placed.groupBy("block").applyInPandas(one_block, schema), "blocks")


def _draw(p: int, rng: np.random.Generator) -> tuple[tuple[int, ...], int]:
    k, pick = int(rng.integers(1, p)), rng.permutation(p)
    return tuple(sorted(pick[:k].tolist())), int(pick[k])


def _valid(blocks: DataFrame, asked: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Those (features, target) such that 10 rows or more are complete on the features and the target is both missing and observed among them."""
    def count(batches):
        for pdf in batches:
            for codes in pdf["codes"]:
                hole = np.array([np.frombuffer(c, np.uint8) == HOLE for c in codes])
                got = []
                for f, t in asked:
                    ok = ~hole[list(f)].any(axis=0)
                    got.append((ok.sum(), (ok & hole[t]).sum()))
                yield pd.DataFrame({"i": np.arange(len(asked)), "n": [int(a) for a, _ in got], "m": [int(b) for _, b in got]})

    sums = blocks.select("codes").mapInPandas(count, "i int, n long, m long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    good = {r["i"] for r in sums.where("n >= 10 AND m > 0 AND m < n").collect()}
    return [x for i, x in enumerate(asked) if i in good]


def _projections(blocks: DataFrame, p: int, most: int, threshold: int, rng: np.random.Generator) -> list[tuple[tuple[int, ...], int]]:
    """All valid (features, target) where they are at most ``threshold``, else the first ``most`` valid ones of random draws."""
    if most_draws(p) <= threshold:
        return _valid(blocks, [(f, t) for t in range(p) for k in range(1, p) for f in itertools.combinations([i for i in range(p) if i != t], k)])
    out: list[tuple[tuple[int, ...], int]] = []
    for _ in range(25):
        out += _valid(blocks, [_draw(p, rng) for _ in range(2 * most)])
        if len(out) >= most:
            break
    return out[:most]


def _arrays(place: bytes, target: bytes, features: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, label, place) of the rows complete on the features, and which rows of the block these are."""
    codes = np.array([np.frombuffer(c, np.uint8) for c in features])
    ok = ~(codes == HOLE).any(axis=0)
    return codes[:, ok], (np.frombuffer(target, np.uint8) == HOLE)[ok].astype(np.int64), np.frombuffer(place, np.int64)[ok], ok


@dataclass(frozen=True)
class PKLMTest:
    """Can missingness be told from values?  Random projections, bagged trees out of bag, and permuted patterns.

    Rows lie as bytes of bin codes in blocks of ``block_rows``; a unit of work is a
    projection on a block.  A table of one block grows each forest in the projection's
    task.  With more blocks every unit of one or two features counts how often trees draw
    its lines of codes, one aggregate adds them up, and ten trees are grown from them in a
    task.  Forests of more features grow level by level: every unit counts its cells
    (tree, node, feature, bin, label), one aggregate adds them up, and the splits of ten
    trees are chosen in a task.  Forests are tables, of a size that only the parameters
    set, and go to the units by broadcast, so that these stay spread.  Trees do not depend
    on the blocks.  Patterns are permuted within blocks, each
    of which is like the whole table: the statistics of permuted patterns, and nothing
    else, change with the blocks.  Only sums by projection come to the driver.

    NaN counts as missing; constant columns split nothing; without rows, or where no
    target is both missing and observed, the test raises.
    """

    nb_projections: int = 100
    nb_projections_threshold: int = 200
    nb_permutation: int = 30
    nb_trees_per_proj: int = 200
    compute_partial_p_values: bool = False
    seed: int = 0
    block_rows: int = 250_000

    def test(self, df: DataFrame) -> float | tuple[float, dict[str, float]]:
        names, target, u = self._statistics(df)

        def p_value(part: np.ndarray) -> float:
            mean = part.mean(axis=0)
            return float((1 + (mean[1:] >= mean[0]).sum()) / len(mean))

        p = p_value(u)
        if not self.compute_partial_p_values:
            return p
        return p, {n: p_value(u[target != j]) if (target != j).any() else math.nan for j, n in enumerate(names)}

    def statistics(self, df: DataFrame) -> np.ndarray:
        """By projection the observed statistic and then those of permuted patterns."""
        return self._statistics(df)[2]

    def _statistics(self, df: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
        coded = canonical(encode(df))
        scratch, forest = Scratch(df.sparkSession), Forest(self.nb_trees_per_proj)
        blocks = coded_blocks(coded, scratch, forest.bins, self.block_rows)
        p = len(coded.columns)
        chosen = _projections(blocks, p, self.nb_projections, self.nb_projections_threshold, rand.generator("pklm", self.seed)) if p > 1 else []
        if not chosen:
            raise LacunaError("no projection has a target that is both missing and observed")
        units, n_blocks = self._units(blocks, chosen)
        if n_blocks == 1:
            probabilities = units.withColumn("model", F.lit(None).cast(_MODEL))
        else:
            probabilities = self._grow(units, chosen, scratch)
        sums = self._sums(probabilities)
        u = np.zeros((len(chosen), self.nb_permutation + 1))
        for r in sums.collect():
            if r["n"] and r["m"]:
                u[r["i"], r["k"]] = r["a"] / r["n"] - r["b"] / r["m"]
        return coded.columns, np.array([t for _, t in chosen]), u

    def _units(self, blocks: DataFrame, chosen: list[tuple[tuple[int, ...], int]]) -> tuple[DataFrame, int]:
        """Each block's columns that a projection needs, a row for each (projection, block), spread over tasks."""
        n_blocks = blocks.count()
        plan = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.array(*[F.lit(j) for j in f]).alias("f")) for i, (f, t) in enumerate(chosen)])
        each = blocks.select("block", "place", "codes", F.explode(plan).alias("x"))
        units = each.select("x.i", "block", "place", F.col("codes")[F.col("x.t")].alias("target"), F.transform("x.f", lambda j: F.col("codes")[j]).alias("features"))
        tasks = min(len(chosen) * n_blocks, max(2000, n_blocks)) if n_blocks > 1 else len(chosen)
        return units.repartitionByRange(tasks, "i", "block"), n_blocks

    def _forest(self, i: int) -> Forest:
        return Forest(self.nb_trees_per_proj, seed=self.seed * 1_000_003 + i)

    def _grow(self, units: DataFrame, chosen: list, scratch: Scratch) -> DataFrame:
        """``units`` with the forests of their projections, whose levels are bytes."""
        stored, forest = scratch.save(units, "units"), Forest()
        few = [forest.few_lines(len(f)) for f, _ in chosen]
        thin = F.pow(F.lit(forest.bins), F.size("features")) <= LINES
        grown = [self._grow_lines(stored.where(thin), chosen, scratch)] if any(few) else []
        grown += [self._grow_levels(stored.where(~thin), chosen, scratch)] if not all(few) else []
        return stored.join(F.broadcast(self._models(functools.reduce(DataFrame.unionAll, grown))), "i")

    def _grow_lines(self, units: DataFrame, chosen: list, scratch: Scratch) -> DataFrame:
        """(i, part, level, feature, place, rate) of forests over few lines, from one count of the lines that trees draw."""
        width, trees = {i: len(f) for i, (f, _) in enumerate(chosen)}, self.nb_trees_per_proj

        def count(batches):
            for pdf in batches:
                for i, place, target, features in zip(pdf["i"], pdf["place"], pdf["target"], pdf["features"]):
                    codes, y, at, _ = _arrays(place, target, features)
                    for part in range(-(-trees // 10)):
                        n = self._forest(i).line_counts(codes, y, at, np.arange(10 * part, min(10 * part + 10, trees))).ravel()
                        cell = np.flatnonzero(n)
                        yield pd.DataFrame({"i": i, "part": part, "cell": cell, "n": n[cell].astype(np.int64)})

        def grow(key, pdf):
            i, part = int(key[0]), int(key[1])
            forest, t = self._forest(i), min(10, trees - 10 * part)
            counts = np.zeros((t, 2 * forest.bins ** width[i]))
            counts.ravel()[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
            return pd.concat(_level(i, part, level, *made) for level, made in enumerate(forest.grow(width[i], counts)))

        drawn = units.select("i", "place", "target", "features").mapInPandas(count, "i int, part int, cell long, n long")
        summed = drawn.groupBy("i", "part", "cell").agg(F.sum("n").alias("n"))
        return scratch.save(summed.groupBy("i", "part").applyInPandas(grow, _LEVEL), "forests")

    def _grow_levels(self, units: DataFrame, chosen: list, scratch: Scratch) -> DataFrame:
        """(i, part, level, feature, place, rate) of any forests, from one count of cells for each level."""
        width, depth, trees = {i: len(f) for i, (f, _) in enumerate(chosen)}, Forest().depth, self.nb_trees_per_proj
        grown = None
        for level in range(depth + 1):
            known = units.withColumn("model", F.lit(None).cast(_MODEL)) if grown is None else units.join(F.broadcast(self._models(grown)), "i")

            def count(batches):
                for pdf in batches:
                    for i, place, target, features, model in zip(pdf["i"], pdf["place"], pdf["target"], pdf["features"], pdf["model"]):
                        forest, (codes, y, at, _) = self._forest(i), _arrays(place, target, features)
                        levels = _levels(model, trees)
                        for part in forest.portions(len(y)):
                            node, _ = forest.walk(codes, [tuple(v[part] for v in lv) for lv in levels], len(part))
                            cell, n = forest.cells(codes, y, draws(at, part, forest.seed), node, level)
                            size = (1 << level) * (len(codes) if level < depth else 1) * forest.bins * 2
                            tree = part[0] + cell // size
                            yield pd.DataFrame({"i": i, "part": tree // 10, "cell": tree % 10 * size + cell % size, "n": n})

            def choose(key, pdf):
                i, part = int(key[0]), int(key[1])
                t = min(10, trees - 10 * part)
                return _level(i, part, level, *self._forest(i).choose(pdf["cell"].to_numpy(), pdf["n"].to_numpy(float), t, width[i], level))

            cells = known.select("i", "place", "target", "features", "model").mapInPandas(count, "i int, part int, cell long, n long")
            summed = cells.groupBy("i", "part", "cell").agg(F.sum("n").alias("n"))
            split = scratch.save(summed.groupBy("i", "part").applyInPandas(choose, _LEVEL), f"level{level}")
            grown = split if grown is None else grown.unionAll(split)
        return grown

    @staticmethod
    def _models(grown: DataFrame) -> DataFrame:
        return grown.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("level", "part", "feature", "place", "rate"))).alias("model"))

    def _sums(self, units: DataFrame) -> DataFrame:
        """(i, k, a, n, b, m): sums of log-odds and rows of the missing and the observed, k = 0 as they are, then permuted."""
        trees, n_perm, seed = self.nb_trees_per_proj, self.nb_permutation, self.seed

        def run(batches):
            for pdf in batches:
                for i, block, place, target, features, model in zip(pdf["i"], pdf["block"], pdf["place"], pdf["target"], pdf["features"], pdf["model"]):
                    forest, (codes, y, at, ok) = self._forest(i), _arrays(place, target, features)
                    p = forest.out_of_bag(codes, y, at, _levels(model, trees))
                    both, hidden = ~np.isnan(p), np.frombuffer(target, np.uint8) == HOLE
                    rows = []
                    for k in range(n_perm + 1):
                        # The same projection with permuted patterns keeps the forest's partition of rows.
                        label = y if not k else hidden[rand.generator("pklm", seed, int(block), k).permutation(len(hidden))][ok]
                        rows.append((i, k, *_odds_sums(p[both], label[both])))
                    yield pd.DataFrame(rows, columns=["i", "k", "a", "n", "b", "m"])

        got = units.select("i", "block", "place", "target", "features", "model").mapInPandas(run, "i int, k int, a double, n long, b double, m long")
        return got.groupBy("i", "k").agg(*[F.sum(c).alias(c) for c in "anbm"])


#: A level of ten trees, and a projection's forest.
_LEVEL = "i int, part int, level int, feature binary, place binary, rate binary"
_MODEL = "array<struct<level: int, part: int, feature: binary, place: binary, rate: binary>>"


def _level(i: int, part: int, level: int, feature: np.ndarray, place: np.ndarray, rate: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": [i], "part": [part], "level": [level], "feature": [feature.astype(np.int16).tobytes()], "place": [place.astype(np.int16).tobytes()], "rate": [rate.astype(float).tobytes()]})


def _levels(model, trees: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, last bin that goes left, rate) by level, each by tree and node."""
    if model is None:
        return []
    by: dict[int, list] = {}
    for m in model:
        by.setdefault(m["level"], []).append(m)
    kinds = (("feature", np.int16), ("place", np.int16), ("rate", float))
    out = []
    for level in sorted(by):
        parts = {m["part"]: m for m in by[level]}
        made = []
        for name, kind in kinds:
            whole = np.full((trees, 1 << level), -1 if name == "feature" else 0, kind)
            for part, m in parts.items():
                v = np.frombuffer(m[name], kind).reshape(-1, 1 << level)
                whole[10 * part : 10 * part + len(v)] = v
            made.append(whole)
        out.append(tuple(made))
    return out
