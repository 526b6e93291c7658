"""Nearest-neighbour imputation with distances over shared columns, by exact pruning.

Rows that agree in every column are one query, and only their first few by key can
be donors.  What is left is laid out in cells of ``CELL`` rows that lie near each
other: by missingness pattern, then along a Z-order curve over the columns' quantile
scales, cut by rank, so a cell's size is fixed whatever the data.  A cell knows its
columns' least and largest values and how many of its rows have each.  From two cells
follow bounds on the distance of any of their rows over the columns that both have:
columns that all rows have enter any average of squares, a column that only some have
may pull it as far as its own square.  ``FAN`` neighbouring cells make a node, ``FAN``
nodes one above.  Cells of queries walk down from the top; a node stays while its
lower bound is within the radius in which the others surely hold enough donors.
Queries then choose among their cell's donors' cells by the same bounds, and rows are
compared only inside those.  Nothing that may be among the nearest is ever left out.

Where incomplete rows x rows of their groups, counted first, are at most
``most_pairs``, the rows are simply joined by group: the same result without the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import LacunaError
from ..frame import numeric_columns
from ..functions.ranks import ranked
from ..storage import Scratch
from .base import Imputer, join_groups, replace

#: Rows of a cell, and nodes under a node.
CELL, FAN = 64, 16

#: Pairs of an incomplete row and a row of its group that are compared without any search.
PAIRS = 1 << 24

#: Steps of a column's quantile scale.
STEPS = 16

#: Allowance for rounding in bounds on squared distances.
SLACK = 1 + 1e-9


def nan_euclidean(columns: list[str], a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """sqrt(d / shared * sum over shared columns of squared differences); NULL where nothing is shared."""
    both = [(a(c), b(c)) for c in columns]
    shared = reduce(lambda x, y: x + y, [F.when(x.isNotNull() & y.isNotNull(), 1).otherwise(0) for x, y in both])
    total = reduce(lambda x, y: x + y, [F.coalesce((x - y) * (x - y), F.lit(0.0)) for x, y in both])
    return F.when(shared > 0, F.sqrt(F.lit(float(len(columns))) / shared * total))


def curve(rows: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Adds ``z``: the row's place on a Z-order curve over its columns, each on its quantile scale."""
    used = list(xs)[:62]
    bits = min(16, 62 // len(used))
    cuts = rows.agg(*[F.percentile_approx(x, [j / STEPS for j in range(STEPS + 1)], 1000) for x in used]).first()

    def level(x: str, at: list[float] | None) -> Column:
        out = F.lit(0.0)
        for j in reversed(range(STEPS if at else 0)):
            if at[j + 1] > at[j]:
                inside = j + (F.col(x) - at[j]) / (at[j + 1] - at[j])
                out = F.when(F.col(x) < at[j + 1], F.greatest(inside, F.lit(0.0))).otherwise(F.lit(float(STEPS)) if at[j + 1] == at[-1] else out)
        return F.coalesce(F.least(F.floor(out / STEPS * (1 << bits)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")

    spread = rows.withColumns({f"z{i}": level(x, at) for i, (x, at) in enumerate(zip(used, cuts))})
    places = [(b, i) for b in reversed(range(bits)) for i in range(len(used))]
    z = reduce(lambda a, c: a.bitwiseOR(c), [F.shiftleft(F.shiftright(f"z{i}", b).bitwiseAND(F.lit(1)), len(places) - 1 - at) for at, (b, i) in enumerate(places)])
    return spread.withColumn("z", z).drop(*[f"z{i}" for i in range(len(used))])


def box(xs: Sequence[str], side: str) -> list[Column]:
    """A node's rows, and its columns' counts, least and largest values, from rows."""
    aggs = [F.count(F.lit(1)).alias(f"{side}n")]
    for i, x in enumerate(xs):
        aggs += [F.count(x).alias(f"{side}c{i}"), F.min(x).alias(f"{side}l{i}"), F.max(x).alias(f"{side}h{i}")]
    return aggs


def above(boxes: DataFrame, d: int) -> DataFrame:
    """The nodes one level up."""
    aggs = [F.sum("bn").alias("bn")]
    for i in range(d):
        aggs += [F.sum(f"bc{i}").alias(f"bc{i}"), F.min(f"bl{i}").alias(f"bl{i}"), F.max(f"bh{i}").alias(f"bh{i}")]
    return boxes.groupBy("g", F.expr(f"node div {FAN}").alias("node")).agg(*aggs)


def bounds(d: int) -> tuple[Column, Column]:
    """(least, most) mean squared difference over shared columns of a row of ``q`` and one of ``b``.

    ``least`` is NULL where no two rows share a column; ``most`` where some two may not.
    """
    sure, low, high, lows, highs = F.lit(0), F.lit(0.0), F.lit(0.0), [F.lit(None).cast("double")], [F.lit(None).cast("double")]
    for i in range(d):
        ql, qh, bl, bh = (F.col(f"{s}{k}{i}") for s in "qb" for k in "lh")
        gap, far = F.greatest(F.lit(0.0), bl - qh, ql - bh), F.greatest(qh - bl, bh - ql)
        always = (F.col(f"qc{i}") == F.col("qn")) & (F.col(f"bc{i}") == F.col("bn"))
        maybe = (F.col(f"qc{i}") > 0) & (F.col(f"bc{i}") > 0) & ~always
        sure, low, high = sure + F.when(always, 1).otherwise(0), low + F.when(always, gap * gap).otherwise(0.0), high + F.when(always, far * far).otherwise(0.0)
        lows.append(F.when(maybe, gap * gap))
        highs.append(F.when(maybe, far * far))
    low, high = F.when(sure > 0, low / sure), F.when(sure > 0, high / sure)
    return F.least(low, *lows), F.when(sure > 0, F.greatest(high, *highs))


def prune(met: DataFrame, query: Sequence[str], d: int, holes: Sequence[int], k: int) -> DataFrame:
    """(query, node) of ``met``, pairs with both boxes, where the node may hold one of the ``k`` nearest donors of a column."""
    least, most = bounds(d)
    wants = {i: F.when((F.col(f"qc{i}") < F.col("qn")) & (F.col(f"bc{i}") > 0), F.col(f"bc{i}")).otherwise(0) for i in holes}
    slim = met.select(*query, "node", least.alias("least"), most.alias("most"), *[w.alias(f"w{i}") for i, w in wants.items()]).where("least IS NOT NULL")
    nearer = Window.partitionBy(*query).orderBy(F.asc_nulls_last("most"), "node").rowsBetween(Window.unboundedPreceding, 0)
    summed = slim.withColumns({f"s{i}": F.sum(F.when(F.col("most").isNotNull(), F.col(f"w{i}")).otherwise(0)).over(nearer) for i in holes})
    radii = summed.withColumns({f"r{i}": F.min(F.when(F.col(f"s{i}") >= k, F.col("most"))).over(Window.partitionBy(*query)) for i in holes})
    near = [(F.col(f"w{i}") > 0) & F.coalesce(F.col("least") <= F.col(f"r{i}") * SLACK, F.lit(True)) for i in holes]
    return radii.where(reduce(lambda a, b: a | b, near)).select(*query, "node")


def _meet(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Rows of one group, NULL ones too, and of ``more`` in common."""
    return left.join(right.withColumnRenamed("g", "bg"), [F.col("g").eqNullSafe(F.col("bg")), *map(F.expr, more)]).drop("bg")


def candidates(rows: DataFrame, xs: Sequence[str], holes: Sequence[int], k: int, scratch: Scratch, most_pairs: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queries, pairs) from ``rows`` (g, key, xs): distinct rows with a hole as (g, i, xs), and (g, i, q, key, xs of a donor).

    ``i`` tells queries of a group apart; ``q`` is the query's columns as a struct.
    """
    d, same = len(xs), Window.partitionBy("g", *xs).orderBy("key")
    first = scratch.save(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k), "rows", tidy=False)
    need = (F.col("nth") == 1) & reduce(lambda a, b: a | b, [F.col(xs[i]).isNull() for i in holes])
    sizes = first.groupBy("g").agg((F.count(F.lit(1)).cast("double") * F.count(F.when(need, 1))).alias("pairs"))
    if (sizes.agg(F.sum("pairs")).first()[0] or 0) <= most_pairs:
        queries = first.where(need).select("g", F.struct("key", "nth").alias("i"), *xs)
        return queries, _meet(queries.select("g", "i", F.struct(*xs).alias("q")), first.drop("nth"))
    bits = F.concat(*[F.when(F.col(x).isNull(), "1").otherwise("0") for x in xs])
    placed = curve(first, xs).withColumn("o", F.struct(bits.alias("bits"), "z", "key", "nth")).drop("z")
    cells = scratch.save(ranked(placed, "g", "o", scratch).drop("o").withColumn("node", F.expr(f"i div {CELL}")), "cells")
    levels = [scratch.save(cells.groupBy("g", "node").agg(*box(xs, "b")), "boxes", tidy=False)]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last >= FAN:
        levels.append(scratch.save(above(levels[-1], d), "boxes", tidy=False))
        last //= FAN
    queries = cells.where(need).select("g", "i", F.col("node").alias("cell"), *xs)
    asked = scratch.save(queries.groupBy("g", "cell").agg(*box(xs, "q")), "asked", tidy=False)

    open_ = prune(_meet(asked, levels[-1]), ["g", "cell"], d, holes, k)
    for level in reversed(levels[:-1]):
        up = scratch.save(open_.withColumnRenamed("node", "up"), "open", tidy=False)
        below = _meet(up, level, f"up = node div {FAN}").drop("up")
        open_ = prune(_meet(below.select("g", "cell", "node", *[c for c in below.columns if c[0] == "b"]), asked.withColumnRenamed("cell", "at"), "cell = at"), ["g", "cell"], d, holes, k)
    open_ = scratch.save(open_, "open", tidy=False)
    as_box = [F.lit(1).alias("qn")] + [c for i, x in enumerate(xs) for c in (F.when(F.col(x).isNull(), 0).otherwise(1).alias(f"qc{i}"), F.col(x).alias(f"ql{i}"), F.col(x).alias(f"qh{i}"))]
    each = _meet(queries.select("g", "i", F.col("cell").alias("at"), *as_box), open_, "cell = at").drop("cell", "at")
    chosen = prune(_meet(each, levels[0].withColumnRenamed("node", "at"), "node = at"), ["g", "i"], d, holes, k)
    mine = queries.select(F.col("g").alias("qg"), F.col("i").alias("qi"), F.struct(*xs).alias("q"))
    full = chosen.join(mine, F.col("g").eqNullSafe(F.col("qg")) & (F.col("i") == F.col("qi"))).drop("qg", "qi")
    return queries, _meet(full, cells.select("g", F.col("node").alias("at"), "key", *xs), "node = at").drop("at")


class ImputerKNN(Imputer):
    """The mean of the ``n_neighbors`` nearest rows of the group that have the column, weighted by 1 / distance.

    Donors at distance 0 count alone; ``weights='uniform'`` gives a plain mean.
    Ties go to the smaller ``key``.  A hole without donors takes the column's
    mean.  Rows are compared only in cells that bounds cannot rule out, and any
    number of equal rows is one query with a few donors; a hot group lies in many
    cells.  With many columns of which no few tell rows apart bounds rule out
    little, and the work goes towards incomplete rows x rows.
    """

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Callable[[DataFrame], DataFrame]:
        if not self.spec.key:
            raise LacunaError("nearest neighbours break ties by key: give key")
        groups, keys, k = self.spec.groups, self.spec.key, int(self.param("n_neighbors", default=5))
        features, weights = [c for c in numeric_columns(df) if c in targets], self.param("weights", default="distance")

        def fill(d: DataFrame) -> DataFrame:
            cols, xs = [c for c in holes if c in features], [f"x{i}" for i in range(len(features))]
            at = [features.index(c) for c in cols]
            group = F.struct(*groups) if groups else F.lit(0)
            numbers = [F.col(c).cast("double") for c in features]
            rows = d.select(group.alias("g"), F.struct(*keys).alias("key"), *[v.alias(x) for v, x in zip(numbers, xs)])
            queries, pairs = candidates(rows, xs, at, k, Scratch(d.sparkSession), self.param("most_pairs", default=PAIRS))
            dist = nan_euclidean(xs, lambda x: F.col("q")[x], F.col)
            gives = [F.when(F.col("q")[xs[i]].isNull() & F.col(xs[i]).isNotNull(), F.struct(F.lit(i).alias("c"), F.col(xs[i]).alias("v"))) for i in at]
            offers = pairs.select("g", "i", "key", dist.alias("dist"), F.explode(F.array(*gives)).alias("o")).where("dist IS NOT NULL AND o IS NOT NULL")
            best = Window.partitionBy("g", "i", "o.c").orderBy("dist", "key")
            near = offers.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
            v, far = F.col("o.v"), F.col("dist") > 0
            weighted = F.coalesce(F.avg(F.when(~far, v)), F.sum(F.when(far, v / F.col("dist"))) / F.sum(F.when(far, 1 / F.col("dist"))))
            est = near.groupBy("g", "i", F.col("o.c").alias("c")).agg((F.avg(v) if weights == "uniform" else weighted).alias("v"))
            wide = est.groupBy(F.col("g").alias("eg"), F.col("i").alias("ei")).agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"_v_{c}") for i, c in zip(at, cols)])
            found = queries.join(wide, F.col("g").eqNullSafe(F.col("eg")) & (F.col("i") == F.col("ei"))).select(F.col("g").alias("_kg"), *[F.col(x).alias(f"_k{x}") for x in xs], *[f"_v_{c}" for c in cols])
            on = [group.eqNullSafe(F.col("_kg"))] + [v.eqNullSafe(F.col(f"_k{x}")) for v, x in zip(numbers, xs)]
            means = d.groupBy(*groups).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
            out = join_groups(d.join(found, on, "left"), means, groups)
            return replace(out, {c: F.coalesce(f"_v_{c}", f"_m_{c}") for c in cols}).select(*d.columns)

        return fill
