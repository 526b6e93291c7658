"""Linear chained equations over all groups at once.

The rows are a stored table: the user's row as one struct, its group as another,
and the numeric columns about their group's means, holes at 0.  A shift changes
no linear model with an intercept, and sums about the means do not cancel.  For
each column and sweep one aggregate gives every group's Gram sums, whatever the
size of a group; the sums become coefficients where they are.  Coefficients of
at most ``SMALL`` numbers in all come through the driver and are broadcast; more
are stored, and the planner joins them by their size.

With draws, a group's noise variance is its residual sum over a chi-squared
variate, its coefficients come from N(b, s2 (X'X + ridge)^-1) of that variance,
and each hole gets noise of its own, keyed by row, column and sweep: so the
result depends on the seed and not on how rows lie in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rand
from ..storage import Scratch


#: Coefficients of all groups, at most, that pass through the driver: 4 MB.
SMALL = 1 << 19


def gram_sums(features: Sequence[str], target: str, rows: Column) -> list[Column]:
    """The upper triangle of sums of products of (1, features, target) over ``rows``, row by row."""
    x = [F.lit(1.0), *map(F.col, features), F.col(target)]
    return [F.coalesce(F.sum(F.when(rows, x[i] * x[j])), F.lit(0.0)) for i in range(len(x)) for j in range(i, len(x))]


def posterior(g: np.ndarray, ridge: float, bayes: bool) -> tuple[np.ndarray, np.ndarray, float, float]:
    """From the Gram matrix of (1, features, y): coefficients, their covariance for noise variance 1, the residual sum, and the rows less the coefficients.

    ``bayes`` takes ridge and noise from evidence iteration on the centred sums;
    the residual sum is then the noise variance times the degrees of freedom.
    """
    k, n = len(g) - 2, g[0, 0]
    dof = n - k - 1
    if bayes and k:
        mean = g[0, 1:-1] / n
        gc, bc, yc = g[1:-1, 1:-1] - n * np.outer(mean, mean), g[1:-1, -1] - g[0, -1] * mean, max(g[-1, -1] - g[0, -1] ** 2 / n, 0.0)
        w, v = np.linalg.eigh(gc)
        w = np.maximum(w, 0)
        alpha, lam, coef = 1 / max(yc / n, 1e-12), 1.0, np.zeros(k)
        for _ in range(300):
            new = v @ ((v.T @ bc) * alpha / (alpha * w + lam))
            gamma = (alpha * w / (lam + alpha * w)).sum()
            rss = max(yc - 2 * new @ bc + new @ gc @ new, 0.0)
            lam, alpha = (gamma + 2e-6) / ((new**2).sum() + 2e-6), (n - gamma + 2e-6) / (rss + 2e-6)
            moved, coef = np.abs(new - coef).sum(), new
            if moved < 1e-3:
                break
        inner = (v / (w + lam / alpha)) @ v.T
        shift = np.concatenate([[-mean], np.eye(k)])
        cov = shift @ inner @ shift.T
        cov[0, 0] += 1 / n
        return np.concatenate([[g[0, -1] / n - mean @ coef], coef]), cov, max(dof, 0) / alpha, dof
    inverse = np.linalg.pinv(g[:-1, :-1] + np.diag([0.0] + [ridge] * k), rcond=1e-12, hermitian=True)
    coef = inverse @ g[:-1, -1]
    return coef, inverse, max(g[-1, -1] - 2 * coef @ g[:-1, -1] + coef @ g[:-1, :-1] @ coef, 0.0), dof


def solver(k: int, ridge: float, bayes: bool, draw: tuple | None):
    """Rows of sums become coefficients (intercept first) and the deviation of a cell's noise (0 without draws)."""
    upper = np.triu_indices(k + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], float).T
            coefs, spread = [], []
            for hashed, sums in zip(batch.column(1).to_pylist(), flat):
                g = np.zeros((k + 2, k + 2))
                g[upper] = g[upper[::-1]] = sums
                if g[0, 0] == 0:  # nothing observed in this group: holes stay at the start
                    coefs.append([0.0] * (k + 1))
                    spread.append(0.0)
                    continue
                coef, cov, rss, dof = posterior(g, ridge, bayes)
                sd = 0.0
                if draw is not None and dof >= 1:
                    rng = rand.generator("chained", *draw, hashed)
                    sd = float(np.sqrt(rss / rng.chisquare(dof)))
                    e, v = np.linalg.eigh(cov)
                    coef = coef + sd * (v * np.sqrt(np.maximum(e, 0))) @ rng.standard_normal(k + 1)
                coefs.append(coef.tolist())
                spread.append(sd)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coefs, pa.list_(pa.float64())), pa.array(spread, pa.float64())], ["g", "coef", "sd"])

    return run


def chained(d: DataFrame, cols: Sequence[str], numbers: Sequence[str], groups: Sequence[str], kind: str, most: int, tol: float, draws: bool = False, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``d`` with the holes of ``cols`` filled from all other ``numbers``, each group by its own models.

    Sweeps go through the columns, fewest holes first, until no cell moves by more
    than ``tol`` times the largest absolute value or ``most`` sweeps are done; with
    draws all ``most`` are.  A column without any value in a group stays NULL there.
    """
    if not cols:
        return d
    scratch = Scratch(d.sparkSession)
    at = {c: i for i, c in enumerate(numbers)}
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g0"))
    rows = d.select(F.struct(*d.columns).alias("row"), group.alias("g"))
    cell = lambda c: F.col("row")[c].cast("double")
    stats = scratch.save(rows.groupBy("g").agg(*[F.avg(cell(c)).alias(f"m{i}") for c, i in at.items()], *[F.sum(F.isnull(cell(c)).cast("long")).alias(f"n{at[c]}") for c in cols], *[F.max(F.abs(cell(c))).alias(f"x{i}") for c, i in at.items()]), "groups", tidy=False)
    total = stats.agg(*[F.sum(f"n{at[c]}") for c in cols], F.max(F.greatest(F.lit(0.0), *[f"x{i}" for i in at.values()])), F.count("*")).first()
    order = [c for _, c in sorted(zip(total, cols))]
    top, few = total[-2] or 0.0, total[-1] * (len(numbers) + 2) <= SMALL
    means = stats.select("g", *[f"m{i}" for i in at.values()])
    met = rows.join(means, "g")
    state = met.select("row", "g", *[F.coalesce(cell(c) - F.col(f"m{i}"), F.lit(0.0)).alias(f"z{i}") for c, i in at.items()], *[F.isnull(cell(c)).alias(f"h{at[c]}") for c in cols], *[F.col(f"m{at[c]}") for c in cols])
    state = scratch.save(state, "state")
    for sweep in range(most):
        now, used = state.select("*", *[F.col(f"z{at[c]}").alias(f"o{at[c]}") for c in cols]), []
        for c in order:
            i = at[c]
            features = [f"z{j}" for j in at.values() if j != i]
            sums = now.groupBy("g").agg(F.xxhash64(F.first("g")).alias("hashed"), *[s.alias(f"s{j}") for j, s in enumerate(gram_sums(features, f"z{i}", ~F.col(f"h{i}")))])
            models = sums.mapInArrow(solver(len(features), 1.0 if kind == "ridge" else 0.0, kind == "bayes", (seed, sweep, i) if draws else None), f"g {sums.schema['g'].dataType.simpleString()}, coef array<double>, sd double")
            if few:
                models = d.sparkSession.createDataFrame(models.toArrow(), models.schema)
            else:
                models = scratch.save(models, f"models{sweep}", tidy=False)
                used.append(models)
            guess = F.col("coef")[0]
            for j, f in enumerate(features, 1):
                guess = guess + F.col("coef")[j] * F.col(f)
            if draws:
                guess = guess + F.col("sd") * rand.normal([F.col("row")[k] for k in keys], seed, sweep * len(numbers) + i)
            now = now.join(models, "g").withColumn(f"z{i}", F.when(F.col(f"h{i}"), guess).otherwise(F.col(f"z{i}"))).drop("coef", "sd")
        stored = scratch.save(now, f"sweep{sweep}", tidy=False)
        scratch.drop(state, *used)
        state = stored.drop(*[f"o{at[c]}" for c in cols])
        state._scratch_path = stored._scratch_path
        if not draws:
            moved = stored.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"z{at[c]}") - F.col(f"o{at[c]}")) for c in cols]))).first()[0] or 0.0
            if moved < tol * top:
                break
    value = lambda c: F.when(F.col(f"h{at[c]}"), F.col(f"z{at[c]}") + F.col(f"m{at[c]}")).otherwise(cell(c))
    return state.select(*[value(c).alias(c) if c in cols else F.col("row")[c].alias(c) for c in d.columns])
