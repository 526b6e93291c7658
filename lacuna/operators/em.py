"""Gaussian and autoregressive imputation by expectation-maximisation.

Gaussian: one scan gives, for each missingness pattern, the number of rows and
the sums and products of the observed columns.  These are all that exact EM needs,
so its iterations touch no row.  Patterns may be as many as rows once there are many
columns, so beyond ``WIDE`` columns each iteration is one pass over the rows instead,
which adds up their expected sums and products.  Columns are taken about their means.
VAR(p) smooths series in blocks of rows (see
``varblocks``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LacunaError
from ..frame import Spec, about_means, bit_set, canonical, numeric_columns, pattern
from ..functions import rand
from ..functions.ranks import ranked
from ..storage import Scratch
from . import varblocks
from .base import Imputer, join_groups
from .simple import interpolated

Fill = Callable[[DataFrame], DataFrame]


#: Columns beyond which a Gaussian is fitted by passes over the rows.
WIDE = 20


def pattern_moments(df: DataFrame, columns: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, _p, n, s_i, q_i_j) by pattern: count, sums, and sums of products of columns observed there."""
    x = [F.col(c).cast("double") for c in columns]
    sums = [F.sum(v).alias(f"s_{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return df.withColumn("_p", pattern(columns)).groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def unpack(row: dict, d: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Observed columns, rows, sums and products of a pattern."""
    o = np.array([i for i in range(d) if not bit_set(row["_p"], i)], int)
    s = np.array([row[f"s_{i}"] for i in o], float)
    q = np.array([[row[f"q_{min(i, j)}_{max(i, j)}"] for j in o] for i in o], float).reshape(len(o), len(o))
    return o, float(row["n"]), s, q


def gaussian_em(rows: list[dict], d: int, most: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """Maximum-likelihood mean and covariance (divisor n) from pattern moments; and the iterations used."""
    parts = [unpack(r, d) for r in rows]
    n = sum(p[1] for p in parts)
    if n < 2:
        raise LacunaError("one row does not make a covariance")
    total, count, square = np.zeros(d), np.zeros(d), np.zeros(d)
    for o, m, s, q in parts:
        total[o] += s
        count[o] += m
        square[o] += np.diag(q)
    mu = total / np.maximum(count, 1)
    sigma = np.diag(np.maximum(square / np.maximum(count, 1) - mu**2, 1e-12))
    for it in range(1, most + 1):
        t1, t2 = np.zeros(d), np.zeros((d, d))
        for o, m, s, q in parts:
            h = np.setdiff1d(np.arange(d), o)
            b = np.zeros((d, len(o)))
            b[o] = np.eye(len(o))
            a = np.zeros(d)
            c = np.zeros((d, d))
            if len(h):
                w = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)], rcond=1e-12) if len(o) else np.zeros((len(h), 0))
                b[h], a[h] = w, mu[h] - w @ mu[o]
                c[np.ix_(h, h)] = sigma[np.ix_(h, h)] - w @ sigma[np.ix_(o, h)]
            bs = b @ s
            t1 += m * a + bs
            t2 += b @ q @ b.T + np.outer(bs, a) + np.outer(a, bs) + m * (np.outer(a, a) + c)
        new_mu = t1 / n
        new_sigma = t2 / n - np.outer(new_mu, new_mu)
        moved = max(np.abs(new_mu - mu).max(), np.abs(new_sigma - sigma).max())
        mu, sigma = new_mu, (new_sigma + new_sigma.T) / 2
        if moved < tol and it >= 3:
            break
    return mu, sigma, it


def alike(hole: np.ndarray) -> list[np.ndarray]:
    """Positions of the rows of each missingness pattern."""
    if not len(hole):
        return []
    _, which = np.unique(np.packbits(hole, axis=1), axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(which[order])) + 1)


def gaussian_em_rows(rows: DataFrame, d: int, most: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``gaussian_em``, from stored rows of ``d`` double columns about their means: one pass an iteration.

    A batch gives the sums of its rows' expected values and products, which Spark
    adds up by place; d x (d + 3) / 2 + 1 numbers reach the driver.
    """
    upper = np.triu_indices(d)

    def step(mu: np.ndarray, sigma: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            n, t1, t2 = 0, np.zeros(d), np.zeros((d, d))
            for pdf in batches:
                x = pdf.to_numpy(float)
                hole = np.isnan(x)
                n += len(x)
                y = conditional(x, mu, sigma)
                t1 += y.sum(axis=0)
                t2 += y.T @ y
                for at in alike(hole):
                    h, o = np.flatnonzero(hole[at[0]]), np.flatnonzero(~hole[at[0]])
                    if len(h):
                        w = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)], rcond=1e-12) if len(o) else np.zeros((len(h), 0))
                        t2[np.ix_(h, h)] += len(at) * (sigma[np.ix_(h, h)] - w @ sigma[np.ix_(o, h)])
            v = np.concatenate([[n], t1, t2[upper]])
            yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

        v = np.array([r["v"] for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
        t2 = np.zeros((d, d))
        t2[upper] = v[1 + d :]
        return v[0], v[1 : 1 + d], t2 + np.triu(t2, 1).T

    spread = rows.agg(*[F.avg(F.col(c) * F.col(c)) for c in rows.columns]).first()
    mu, sigma = np.zeros(d), np.diag(np.maximum([v or 0.0 for v in spread], 1e-12))
    for it in range(1, most + 1):
        n, t1, t2 = step(mu, sigma)
        if n < 2:
            raise LacunaError("one row does not make a covariance")
        new_mu = t1 / n
        new_sigma = t2 / n - np.outer(new_mu, new_mu)
        moved = max(np.abs(new_mu - mu).max(), np.abs(new_sigma - sigma).max())
        mu, sigma = new_mu, (new_sigma + new_sigma.T) / 2
        if moved < tol and it >= 3:
            break
    return mu, sigma, it


def conditional(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Rows with holes filled by the conditional mean, plus, with ``noise``, a draw from the conditional law."""
    out = x.copy()
    hole = np.isnan(x)
    for rows in alike(hole):
        if not hole[rows[0]].any():
            continue
        h = np.flatnonzero(hole[rows[0]])
        o = np.flatnonzero(~hole[rows[0]])
        w = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)], rcond=1e-12) if len(o) else np.zeros((len(h), 0))
        fill = mu[h] + (x[np.ix_(rows, o)] - mu[o]) @ w.T
        if noise is not None:
            e, v = np.linalg.eigh(sigma[np.ix_(h, h)] - w @ sigma[np.ix_(o, h)])
            fill += noise[np.ix_(rows, h)] @ (v * np.sqrt(np.maximum(e, 0))).T
        out[np.ix_(rows, h)] = fill
    return out


class ImputerEM(Imputer):
    """``model``: multinormal (i.i.d. rows) or VAR (``p`` lags, None for AIC over all groups).

    ``method``: mle fills conditional means; sample draws from the conditional
    law of all missing cells, keyed by seed and row (VAR: by group and block).  Each
    group has its own model.  VAR: cells before a group's first full row keep the
    interpolation; ``period`` folds rows; series of less than p + 3 rows have no model.
    """

    leaves_none = False

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        most, tol, groups = int(self.param("max_iter_em", default=200)), float(self.param("tolerance", default=1e-4)), self.spec.groups
        cols = [c for c in numeric_columns(df) if c in targets]
        if self.param("model", default="multinormal") == "VAR":
            self.spec.ordered("an autoregressive model")
            return self._fit_var(df, cols, [c for c in holes if c in cols])
        d = len(cols)
        about, middle = about_means(df, cols)
        if groups:
            moments = pattern_moments(about, cols, groups)
            kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
            schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", _mu array<double>, _sigma array<double>"

            def solve(pdf: pd.DataFrame) -> pd.DataFrame:
                out = pdf[list(groups)].iloc[:1].copy()
                rows = pdf.to_dict("records")
                if sum(r["n"] for r in rows) < 2:
                    return out.assign(_mu=[None], _sigma=[None])
                mu, sigma, _ = gaussian_em(rows, d, most, tol)
                return out.assign(_mu=[(mu + middle).tolist()], _sigma=[sigma.ravel().tolist()])

            models = moments.groupBy(*groups).applyInPandas(solve, schema)
        else:
            if d > WIDE:
                mu, sigma, _ = gaussian_em_rows(Scratch(df.sparkSession).save(about.select(*cols), "rows", tidy=False), d, most, tol)
            else:
                mu, sigma, _ = gaussian_em([r.asDict() for r in pattern_moments(about, cols).collect()], d, most, tol)  # at most 2 ** WIDE rows
            models = (mu + middle, sigma)
        draw, keys = self.param("method", default="mle") == "sample", self.spec.key or self.spec.order_by
        if draw and not keys:
            raise LacunaError("draws are keyed by row: give key")

        def fill(d0: DataFrame) -> DataFrame:
            if isinstance(models, tuple):
                out = d0
            else:
                out = join_groups(d0, models, groups)
            if draw:
                out = out.withColumns({f"_z_{i}": rand.normal(keys, self.seed, i) for i in range(d)})

            names, one = list(d0.columns), models if isinstance(models, tuple) else None

            def run(batches):
                for pdf in batches:
                    x = pdf[cols].to_numpy(float)
                    z = pdf[[f"_z_{i}" for i in range(d)]].to_numpy(float) if draw else None
                    if one:
                        pdf[cols] = conditional(x, *one, z)
                        yield pdf[names]
                        continue
                    tag = pd.Series([None if m is None else bytes(np.array([*m, *s])) for m, s in zip(pdf["_mu"], pdf["_sigma"])], dtype=object)
                    y = x.copy()
                    for _, rows in tag.groupby(tag).indices.items():
                        mu, sigma = np.array(pdf["_mu"].iloc[rows[0]]), np.array(pdf["_sigma"].iloc[rows[0]]).reshape(d, d)
                        y[rows] = conditional(x[rows], mu, sigma, None if z is None else z[rows])
                    pdf[cols] = y
                    yield pdf[names]

            schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType, True) for f in d0.schema])
            return canonical(out.mapInPandas(run, schema), cols)

        return fill

    def _series(self, d: DataFrame, cols: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """The table's rows with group, series row ``i`` and place ``k`` in it; and the series rows (g, i, v, z)."""
        period, nan = int(self.param("period", default=1)), F.lit(float("nan"))
        group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(self.spec.groups)]) if self.spec.groups else F.struct(F.lit(0).alias("g0"))
        rows = d.select(F.struct(*d.columns).alias("row"), group.alias("g"), F.struct(*self.spec.order_by).alias("order"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        names = [f"x{i}" for i in range(len(cols))]
        placed = scratch.save(ranked(rows, "g", "order", scratch), "placed")
        guessed = interpolated(placed.select("g", "i", *names), names, Spec.of(["i"], [], ["g"]), "linear", None, max(1, placed.count() // 1_000_000))
        guessed = guessed.select("g", "i", F.array(*[F.coalesce(n, nan) for n in names]).alias("v"), F.array(*[F.coalesce(n, f"_i_{n}", F.lit(0.0)) for n in names]).alias("z"))
        kept = placed.select("row", "g", F.floor(F.col("i") / period).alias("i"), (F.col("i") % period).cast("int").alias("k"))
        if period == 1:
            return kept, scratch.save(guessed, "series")
        cells = guessed.groupBy("g", F.floor(F.col("i") / period).alias("i")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") % period).cast("int"), F.struct("v", "z")))).alias("m"))
        lines = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda k: F.element_at("m", k))
        side = lambda c, gap: F.flatten(F.transform(lines, lambda r: F.coalesce(r[c], F.array_repeat(gap, len(cols))))).alias(c)
        return kept, scratch.save(cells.select("g", "i", side("v", nan), side("z", F.lit(0.0))), "series")

    def _fit_var(self, df: DataFrame, cols: list[str], asked: list[str]) -> Fill:
        scratch, most, tol = Scratch(df.sparkSession), int(self.param("max_iter_em", default=20)), float(self.param("tolerance", default=1e-4))
        period, lags, length = int(self.param("period", default=1)), self.param("p"), self.param("block")
        d = period * len(cols)
        _, rows = self._series(df, cols, scratch)
        if lags is None:
            lags = min(range(1, int(self.param("max_lag", default=2)) + 1), key=lambda k: _aic(varblocks.Series(rows, d, k, scratch, length), k))
        series = varblocks.Series(rows, d, int(lags), scratch, length)
        fitted = scratch.save(series.fit(most, tol).join(series.groups, "gid").select(F.col("g").alias("fg"), "p"), "fitted", tidy=False)
        seed = self.seed if self.param("method", default="mle") == "sample" else None

        def fill(d0: DataFrame) -> DataFrame:
            scratch = Scratch(d0.sparkSession)
            placed, rows = self._series(d0, cols, scratch)
            now = varblocks.Series(rows, d, int(lags), scratch, length)
            params = scratch.save(now.groups.join(fitted, F.col("g") == F.col("fg")).select("gid", "p"), "parameters", tidy=False)
            seen = rows.groupBy("g").agg(*[F.max(F.exists(F.array(*[~F.isnan(F.col("v")[k * len(cols) + j]) for k in range(period)]), lambda x: x)).alias(f"seen{j}") for j in range(len(cols))])
            filled = now.filled(params, seed).join(now.groups.select("gid", "g"), "gid").join(seen, "g")
            filled = filled.select(F.col("g").alias("fg"), F.col("i").alias("fi"), "m", *[f"seen{j}" for j in range(len(cols))])
            met = placed.join(filled, (F.col("g") == F.col("fg")) & (F.col("i") == F.col("fi")), "left")
            # A column without any value in a group has no law there.
            value = lambda c: F.coalesce(F.col("row")[c].cast("double"), F.when(F.col(f"seen{cols.index(c)}"), F.get("m", F.col("k") * len(cols) + cols.index(c))))
            return met.select(*[value(c).alias(c) if c in asked else F.col("row")[c].alias(c) for c in d0.columns])

        return fill


def _aic(series: varblocks.Series, lags: int) -> float:
    """Over all groups, of the model with so many lags on the starting values."""
    d = series.d

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"aic": [n * float(np.linalg.slogdet(np.reshape(p[-d * d :], (d, d)))[1]) + 2 * lags * d * d for n, p in zip(pdf["n"], pdf["p"])]})

    fitted = series.fit(0, 0.0).join(series.groups, "gid").select((F.col("n") - lags).cast("double").alias("n"), "p")
    return fitted.mapInPandas(run, "aic double").agg(F.sum("aic")).first()[0] or 0.0
