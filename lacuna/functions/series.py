"""Second-order statistics and foldings of tables with missing cells, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Spec


def acf(df: DataFrame, column: str, spec: Spec, lags: int) -> DataFrame:
    """(lag, r): the correlation of a series with itself ``lag`` rows before, for lags below ``lags``: one sort, one aggregate."""
    w = spec.ordered("autocorrelation")
    wide = df.select(F.col(column).alias("v"), *[F.lag(column, k).over(w).alias(f"l{k}") for k in range(1, lags)])
    row = wide.agg(F.lit(1.0).alias("r0"), *[F.corr("v", f"l{k}").alias(f"r{k}") for k in range(1, lags)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("r")) for k in range(lags)])))


def lag_table(df: DataFrame, column: str, spec: Spec, p: int) -> DataFrame:
    """(groups, y, z1..zp): each row's value and the p before it, nearest first; rows without p before them go."""
    w = spec.ordered("lags")
    wide = df.select(*spec.groups, F.col(column).alias("y"), F.row_number().over(w).alias("rank"), *[F.lag(column, k).over(w).alias(f"z{k}") for k in range(1, p + 1)])
    return wide.where(F.col("rank") > p).drop("rank")


def folded(df: DataFrame, column: str, spec: Spec, period: int) -> DataFrame:
    """(groups, row, col, v): the series as a matrix of ``period`` columns, a row for each cell."""
    i = F.row_number().over(spec.ordered("folding")) - 1
    cells = df.select(*spec.groups, i.cast("long").alias("i"), F.col(column).alias("v"))
    return cells.select(*spec.groups, F.floor(F.col("i") / period).alias("row"), (F.col("i") % period).alias("col"), "v")


def nan_mean_cov(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means of what is observed, and covariances about them over the rows where both columns are, divided by their number less one.

    Two aggregates: the first gives the means, the second sums of centred
    products, so nothing is lost to cancellation and nothing meets in one task.
    """
    mean = np.array([np.nan if m is None else m for m in df.agg(*[F.avg(c) for c in columns]).first()], float)
    centred = df.select(*[(F.col(c) - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, mean))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = centred.agg(*[f for i, j in pairs for f in (F.sum(F.col(f"c{i}") * F.col(f"c{j}")), F.count(F.col(f"c{i}") * F.col(f"c{j}")))]).first()
    cov = np.full((len(columns), len(columns)), np.nan)
    for k, (i, j) in enumerate(pairs):
        total, n = row[2 * k], row[2 * k + 1]
        cov[i, j] = cov[j, i] = total / (n - 1) if n > 1 else np.nan
    return mean, cov
