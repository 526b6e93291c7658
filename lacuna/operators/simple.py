"""Imputers that are plain expressions: truth, statistics, carry, interpolation, seasonal residuals, draws."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import LacunaError
from ..frame import is_numeric
from .base import Imputer, join_groups, mode_by, replace

Fill = Callable[[DataFrame], DataFrame]


class ImputerOracle(Imputer):
    """Fills from a table of true values, matched by ``key``; without one, 0."""

    leaves_none = False

    def __init__(self, solution: DataFrame | None = None, **kw):
        super().__init__(**kw)
        self.solution = solution

    def set_solution(self, solution: DataFrame) -> ImputerOracle:
        self.solution = solution
        return self

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        if self.solution is None:
            return lambda d: replace(d, {c: F.lit(0) for c in holes if is_numeric(d, c)})
        if not self.spec.key:
            raise LacunaError("a solution is matched by key: give key")
        keys = self.spec.key

        def fill(d: DataFrame) -> DataFrame:
            truth = self.solution.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_t_{c}") for c in holes])
            both = d.join(truth, [d[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
            return replace(both, {c: F.col(f"_t_{c}") for c in holes}).select(*d.columns)

        return fill


class ImputerSimple(Imputer):
    """Mean, median, most frequent value or a constant of the column, in each group.

    ``strategy`` is median by default; columns that hold no numbers always take
    the most frequent value, of equals the smallest.  With ``refit`` (default)
    the statistics are those of the table being filled; without, those of the
    table that was fitted, kept as a table by group.
    """

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        groups = self.spec.groups

        def strategy(d: DataFrame, c: str) -> str:
            return self.param("strategy", c, "median") if is_numeric(d, c) else "most_frequent" if self.param("strategy", c, "median") != "constant" else "constant"

        def statistics(d: DataFrame, cols: list[str]) -> DataFrame:
            makes = {"mean": F.avg, "median": F.median}
            return d.groupBy(*groups).agg(*[makes[strategy(d, c)](c).alias(f"_s_{c}") for c in cols])

        def fill_from(d: DataFrame, source: DataFrame) -> DataFrame:
            plain = [c for c in holes if strategy(d, c) in ("mean", "median")]
            out, values = d, {c: F.col(f"_s_{c}") for c in plain}
            if plain:
                out = join_groups(out, statistics(source, plain), groups)
            for c in holes:
                kind = strategy(d, c)
                if kind == "constant":
                    values[c] = F.lit(self.param("fill_value", c, 0 if is_numeric(d, c) else "missing_value"))
                elif kind == "most_frequent":
                    out = join_groups(out, mode_by(source, c, groups).withColumnRenamed("_mode", f"_s_{c}"), groups)
                    values[c] = F.col(f"_s_{c}")
                elif kind not in ("mean", "median"):
                    raise LacunaError(f"unknown strategy {kind}")
            return replace(out, values).select(*d.columns)

        return (lambda d: fill_from(d, d)) if self.param("refit", default=True) else (lambda d: fill_from(d, df))


class ImputerShuffle(Imputer):
    """Each missing cell draws one of the group's observed values, by a hash of its key and the seed."""

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        groups = self.spec.groups
        keys = self.spec.key or self.spec.order_by
        if not keys:
            raise LacunaError("draws are keyed by row: give key")

        def fill(d: DataFrame) -> DataFrame:
            out = d
            for i, c in enumerate(holes):
                donors = d.where(F.col(c).isNotNull())
                at = Window.partitionBy(*groups).orderBy(*keys)
                ranked = donors.select(*groups, F.row_number().over(at).alias("_r"), F.col(c).alias(f"_d_{c}"))
                sizes = donors.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
                drawn = join_groups(out, sizes, groups).withColumn("_r0", F.when(F.col(c).isNull(), F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), *keys), F.col("_n")) + 1))
                right = ranked.withColumnsRenamed({g: f"_g_{g}" for g in groups})
                on = [drawn[g].eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_r0") == F.col("_r")]
                out = replace(drawn.join(right, on, "left"), {c: F.col(f"_d_{c}")}).select(*d.columns)
            return out

        return fill


#: Rows of a block when a table is cut into ranges of its order.
BLOCK_ROWS = 1_000_000


def blocks(df: DataFrame, order: str, n: int) -> Column:
    """The block of a row among ``n`` ranges of one ordered column, from approximate quantiles; one block for columns without numbers."""
    kind = df.schema[order].dataType
    if n < 2 or not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0)
    value = F.unix_date(order).cast("double") if isinstance(kind, T.DateType) else F.col(order).cast("timestamp").cast("double") if isinstance(kind, T.TimestampNTZType) else F.col(order).cast("double")
    cuts = df.select(value.alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.001)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x <= value)), F.lit(0)) if cuts else F.lit(0)


def neighbours(df: DataFrame, columns: list[str], spec, at: str | None = None, n: int = 1) -> DataFrame:
    """Adds ``_rn``, the rank in the group, and for each column c the observations around: ``_p_<c>`` before or here, ``_q_<c>`` here or after.

    Both are (r, x), position and value.  Each is a running last value, forward
    and on the reversed order, so time is in proportion to the rows.  With ``n``
    over 1, ranges of the first order column cut every group into blocks, which
    are windows of their own; a table of one row for each group and block carries
    ranks and observations across their borders.
    """
    w = spec.ordered("carrying values")
    part = [*spec.groups]
    out = df
    if n > 1:
        out, part = out.withColumn("_b", blocks(df, spec.order_by[0], n)), [*part, "_b"]
        w = Window.partitionBy(*part).orderBy(*spec.order_by)
    out = out.withColumn("_rn", F.row_number().over(w))
    ahead = Window.partitionBy(*part).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*part).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)

    def seen(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(place(df, at, F.col("_rn").cast("double")).alias("r"), F.col(c).alias("x")))

    if n > 1:
        edge = out.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *[f(seen(c), F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_{k}e_{c}") for c in columns for k, f in (("p", F.max_by), ("q", F.min_by))])
        up = Window.partitionBy(*spec.groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*spec.groups).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.withColumn("_off", F.coalesce(F.sum("_n").over(up), F.lit(0)))
        moved = lambda e: F.when(e.isNotNull(), F.struct((e["r"] + (F.col("_off") if at is None else 0)).alias("r"), e["x"].alias("x")))
        edge = edge.withColumns({f"_{k}e_{c}": moved(F.col(f"_{k}e_{c}")) for c in columns for k in "pq"})
        edge = edge.select(*part, "_off", *[F.last(f"_{k}e_{c}", True).over(o).alias(f"_{k}e_{c}") for c in columns for k, o in (("p", up), ("q", down))])
        out = join_groups(out, edge, part).withColumn("_rn", F.col("_rn") + F.col("_off"))
    around = {}
    for c in columns:
        around |= {f"_p_{c}": F.last(seen(c), True).over(ahead), f"_q_{c}": F.last(seen(c), True).over(back)}
    out = out.withColumns(around)
    if n > 1:
        out = out.withColumns({f"_{k}_{c}": F.coalesce(f"_{k}_{c}", f"_{k}e_{c}") for c in columns for k in "pq"}).drop("_b", "_off", *[f"_{k}e_{c}" for c in columns for k in "pq"])
    return out


def n_blocks(imputer: Imputer) -> int:
    """The parameter, else one block for each BLOCK_ROWS rows of the fitted table."""
    return int(imputer.param("n_blocks", default=0)) or -(-imputer.rows // BLOCK_ROWS) or 1


class _Carry(Imputer):
    """``n_blocks`` cuts groups, or a table without groups, into ranges for several tasks; by default one for each million rows."""

    needs_order = True
    forward_first = True

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        spec, n = self.spec, n_blocks(self)

        def fill(d: DataFrame) -> DataFrame:
            order = ("p", "q") if self.forward_first else ("q", "p")
            near = neighbours(d, holes, spec, None, n)
            return replace(near, {c: F.coalesce(*[F.col(f"_{k}_{c}")["x"] for k in order]) for c in holes}).select(*d.columns)

        return fill


class ImputerLOCF(_Carry):
    """The last observation before, else the first after."""


class ImputerNOCB(_Carry):
    """The first observation after, else the last before."""

    forward_first = False


def place(df: DataFrame, column: str | None, order: Column) -> Column:
    """Position of a row for interpolation: its rank, or the value of ``column`` (times in microseconds)."""
    if column is None:
        return order
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())).cast("double")
    return F.unix_micros(column).cast("double") if isinstance(kind, T.TimestampType) else F.col(column).cast("double")


def interpolated(df: DataFrame, columns: list[str], spec, method: str, at: str | None, n: int = 1) -> DataFrame:
    """Adds ``_i_<c>``: column c with holes filled between their neighbours, flat at the ends."""
    out = neighbours(df, columns, spec, at, n)
    pos = place(df, at, F.col("_rn").cast("double"))
    new: dict[str, Column] = {}
    for c in columns:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        if method in ("linear", "index", "values", "time", "slinear"):
            span = q["r"] - p["r"]
            inner = p["x"] + F.when(span != 0, (q["x"] - p["x"]) * (pos - p["r"]) / span).otherwise(0)
        elif method == "nearest":
            inner = F.when(pos - p["r"] <= q["r"] - pos, p["x"]).otherwise(q["x"])
        elif method in ("zero", "pad", "ffill"):
            inner = p["x"]
        elif method in ("bfill", "backfill"):
            inner = q["x"]
        else:
            raise LacunaError(f"unknown interpolation {method}")
        new[f"_i_{c}"] = F.coalesce(F.col(c), F.when(p.isNull(), q["x"]).when(q.isNull(), p["x"]).otherwise(inner))
    return out.withColumns(new).drop(*[f"_{k}_{c}" for c in columns for k in "pq"])


def solve_band(first: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solves A c = y, row i of A holding ``rows[i]`` in columns ``first[i]`` and on, these with column i among them.

    Short blocks are solved at once, each for its own part and for the borders it
    shares with its neighbours; the chain of borders is a small block-tridiagonal
    system.  Work and memory are linear in the rows.  Splines' matrices are totally
    positive, so blocks on the diagonal are not singular.
    """
    n, k = len(y), rows.shape[1] - 1
    if not k:
        return y / rows[:, 0]
    m = max(16, 4 * k)
    nb = -(-n // m)
    i = np.repeat(np.arange(n), k + 1)
    at = (first[:, None] + np.arange(k + 1)).ravel()
    b, r, v = i // m, i % m, rows.ravel()
    local = at - b * m
    own, right = np.zeros((nb, m, m)), np.zeros((nb, m, 1 + 2 * k))  # right: y, then the last k unknowns before and the first k after
    own[:, range(m), range(m)] = np.arange(nb * m).reshape(nb, m) >= n
    right.reshape(nb * m, -1)[:n, 0] = y
    for keep, put in (((local >= 0) & (local < m), None), (local < 0, 1 + k), (local >= m, 1 + k - m)):
        if put is None:
            own[b[keep], r[keep], local[keep]] = v[keep]
        else:
            inside = keep & (v != 0)
            right[b[inside], r[inside], local[inside] + put] = v[inside]
    part = np.linalg.solve(own, right)
    ends = np.concatenate([part[:, :k], part[:, -k:]], axis=1)
    known, after = np.zeros((nb, 2 * k)), np.zeros((nb, 2 * k, k))  # borders = known - after x first unknowns of the next block
    for j in range(nb):
        before, lhs, rhs = ends[j, :, 1 : 1 + k], np.eye(2 * k), ends[j, :, 0]
        if j:
            lhs[:, :k] -= before @ after[j - 1, k:]
            rhs = rhs - before @ known[j - 1, k:]
        got = np.linalg.solve(lhs, np.column_stack([rhs, ends[j, :, 1 + k :]]))
        known[j], after[j] = got[:, 0], got[:, 1:]
    border = known.copy()
    for j in range(nb - 2, -1, -1):
        border[j] -= after[j] @ border[j + 1, :k]
    low, high = np.zeros((nb, k)), np.zeros((nb, k))
    low[1:], high[:-1] = border[:-1, k:], border[1:, :k]
    out = part[:, :, 0] - (part[:, :, 1 : 1 + k] @ low[:, :, None])[:, :, 0] - (part[:, :, 1 + k :] @ high[:, :, None])[:, :, 0]
    return out.ravel()[:n]


def basis(knots: np.ndarray, k: int, n: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the k + 1 B-splines of degree k that may differ from 0 at each place, and their values."""
    span = np.clip(np.searchsorted(knots, t, side="right") - 1, k, n - 1)
    v = np.ones((len(t), 1))
    for d in range(1, k + 1):
        low, high = knots[span[:, None] + np.arange(1 - d, 1)], knots[span[:, None] + np.arange(1, d + 1)]
        share = v / (high - low)
        v = np.zeros((len(t), d + 1))
        v[:, :-1] += share * (high - t[:, None])
        v[:, 1:] += share * (t[:, None] - low)
    return span - k, v


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating B-spline with knots at the data (averaged), flat outside the data's range; of equal places the mean counts.

    Linear in the rows.
    """
    x, which = np.unique(x, return_inverse=True)
    y = np.bincount(which, y) / np.bincount(which)
    n = len(x)
    k = min(degree, n - 1)
    if k < 1:
        return np.full(len(at), y[0] if n else np.nan)
    middle, scale = (x[0] + x[-1]) / 2, x[-1] - x[0]
    x, at = (x - middle) / scale, (np.clip(at, x[0], x[-1]) - middle) / scale
    inner = np.lib.stride_tricks.sliding_window_view(x[1:-1], k).mean(axis=1) if n > k + 1 else np.zeros(0)
    knots = np.concatenate([np.full(k + 1, x[0]), inner, np.full(k + 1, x[-1])])
    c = solve_band(*basis(knots, k, n, x), y)
    first, v = basis(knots, k, n, at)
    return (v * c[first[:, None] + np.arange(k + 1)]).sum(axis=1)


class ImputerInterpolation(Imputer):
    """Interpolation between neighbours, flat at the ends.

    ``method``: linear (by rank), index, values or time (by ``col_time``),
    nearest, zero, slinear, pad, ffill, bfill; quadratic, cubic, spline or
    polynomial (``order``) are B-splines fitted in one task for each group.
    """

    needs_order = True

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        method, at = self.param("method", default="linear"), self.param("col_time")
        degrees = {"quadratic": 2, "cubic": 3, "spline": self.param("order", default=3), "polynomial": self.param("order", default=3)}
        if method in degrees:
            return per_group(self, holes, lambda pdf, cols: _spline_group(pdf, cols, degrees[method], at if at in pdf else None))
        by_place = at if method in ("index", "values", "time") else None
        n = n_blocks(self)
        return lambda d: replace(interpolated(d, holes, self.spec, method, by_place, n), {c: F.col(f"_i_{c}") for c in holes}).select(*d.columns)


def _spline_group(pdf: pd.DataFrame, columns: list[str], degree: int, at: str | None) -> pd.DataFrame:
    t = pd.to_numeric(pdf[at]).to_numpy(float) if at else np.arange(len(pdf), dtype=float)
    for c in columns:
        y = pdf[c].to_numpy(float)
        ok = ~np.isnan(y)
        if ok.any() and not ok.all():
            pdf[c] = np.where(ok, y, spline(t[ok], y[ok], t, degree))
    return pdf


def per_group(imputer: Imputer, holes: list[str], run: Callable[[pd.DataFrame, list[str]], pd.DataFrame]) -> Fill:
    """Applies a pandas function to each group's rows in order; only its values of missing cells are used.

    A group is held in one task; without groups the whole table is.
    """
    spec = imputer.spec

    def fill(d: DataFrame) -> DataFrame:
        from pyspark.sql.types import StructField, StructType

        schema = StructType([StructField(f.name, T.DoubleType() if f.name in holes and isinstance(f.dataType, T.NumericType) else f.dataType, True) for f in d.schema])

        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            if spec.order_by:
                pdf = pdf.sort_values(list(spec.order_by), kind="stable").reset_index(drop=True)
            old = pdf[holes].copy()
            new = run(pdf.copy(), holes)
            for c in holes:
                pdf[c] = old[c].where(old[c].notna(), new[c])
            return pdf

        return d.groupBy(*spec.groups).applyInPandas(apply, schema)

    return fill


class ImputerResiduals(Imputer):
    """Seasonal decomposition: holes take trend plus season plus interpolated residual.

    The series is interpolated, its trend a centred moving average over
    ``period`` rows carried to the ends by least squares over ``period`` trend
    points, its season the centred mean by position in the period.  Residuals at
    holes are interpolated.  ``model_tsa`` is additive or multiplicative.  All in
    windows over one ordering of each group.
    """

    needs_order = True

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        p, times = int(self.param("period", default=1)), self.param("model_tsa", default="additive") == "multiplicative"

        def fill(d: DataFrame) -> DataFrame:
            spec, out, values = self.spec, d, {}
            w, g = spec.ordered("seasonal residuals"), spec.grouped()
            for c in holes:
                x, half = F.col("_x"), p // 2
                s = interpolated(out, [c], spec, "linear", None).withColumnRenamed(f"_i_{c}", "_x")
                s = s.withColumn("_n", F.count(F.lit(1)).over(g))
                if p % 2:
                    raw = F.avg("_x").over(w.rowsBetween(-half, half))
                else:
                    inner = F.sum("_x").over(w.rowsBetween(-half + 1, half - 1)) if half > 1 else x
                    raw = (inner + (F.lag("_x", half).over(w) + F.lead("_x", half).over(w)) / 2) / p
                rn = F.col("_rn")
                s = s.withColumn("_t", F.when((rn > half) & (rn <= F.col("_n") - half), raw))
                first, last = (rn > half) & (rn <= half + p), (rn <= F.col("_n") - half) & (rn > F.col("_n") - half - p)
                for side, part in (("a", first), ("b", last)):
                    y, t = F.when(part, F.col("_t")), F.when(part & F.col("_t").isNotNull(), rn)
                    s = s.withColumns({f"_m{side}": F.coalesce(F.regr_slope(y, t).over(g), F.lit(0.0)), f"_y{side}": F.avg(y).over(g), f"_r{side}": F.avg(t).over(g)})
                line = lambda k: F.col(f"_y{k}") + F.col(f"_m{k}") * (rn - F.col(f"_r{k}"))
                s = s.withColumn("_t", F.coalesce("_t", F.when(rn <= half, line("a")).otherwise(line("b")), F.avg("_x").over(g)))
                s = s.withColumn("_k", (rn - 1) % p).withColumn("_d", x / F.col("_t") if times else x - F.col("_t"))
                s = s.withColumn("_s", F.avg("_d").over(spec.grouped().partitionBy(*spec.groups, "_k")))
                # The mean of the period means: each position once, by its first row.
                centre = F.avg(F.when(rn <= p, F.col("_s"))).over(g)
                s = s.withColumn("_s", F.col("_s") / centre if times else F.col("_s") - centre)
                base = F.col("_t") * F.col("_s") if times else F.col("_t") + F.col("_s")
                s = s.withColumn("_e", F.when(F.col(c).isNotNull(), x / base if times else x - base)).withColumn("_base", base).drop("_rn")
                s = interpolated(s, ["_e"], spec, "linear", None)
                made = F.col("_base") * F.col("_i__e") if times else F.col("_base") + F.col("_i__e")
                out = s.withColumn(f"_v_{c}", made).select(*out.columns, f"_v_{c}")
                values[c] = F.col(f"_v_{c}")
            return replace(out, values).select(*d.columns)

        return fill
