"""Scores of imputations: truth, imputed values and masks on the same row.

A scored table holds for each column ``c`` the truth ``c``, the imputed value
``c<suffix>`` and the boolean mask ``m_c``; masks and values on one row need no
join.  Column metrics of all columns are one aggregate or one shuffle for each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import LacunaError, NotEnoughSamples
from ..frame import about_means, bit_set, bits
from ..functions import linalg, special
from . import distances

SUFFIX, MASK = "_imputed", "m_"
EPS = 2.220446049250313e-16


def scored(truth: DataFrame, imputed: DataFrame, mask: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key from three tables of the same key."""
    b = imputed.select(*key, *[F.col(c).alias(c + SUFFIX) for c in columns])
    m = mask.select(*key, *[F.col(c).alias(MASK + c) for c in columns])
    return truth.select(*key, *columns).join(b, list(key)).join(m, list(key))


def _xy(c: str) -> tuple[Column, Column, Column]:
    return F.col(c), F.col(c + SUFFIX), F.col(MASK + c)


def pointwise(columns: Sequence[str], names: Sequence[str], groups: Sequence[str] = ()) -> list[Column]:
    """Aggregate expressions ``<name>__<column>`` of pointwise metrics, for one pass over all columns."""
    out = []
    for c in columns:
        x, y, m = _xy(c)
        err = F.when(m, F.abs(x - y))
        made = {
            "mse": lambda: F.avg(F.when(m, (x - y) * (x - y))),
            "rmse": lambda: F.sqrt(F.avg(F.when(m, (x - y) * (x - y)))),
            "mae": lambda: F.avg(err),
            "mape": lambda: F.avg(err / F.greatest(F.abs(x), F.lit(EPS))),
            "wmape": lambda: F.sum(err) / F.sum(F.when(m, F.abs(x))),
            "accuracy": lambda: F.avg(F.when(m, x.eqNullSafe(y).cast("double"))),
        }
        out += [made[n]().alias(f"{n}__{c}") for n in names if n in made]
    return out


POINTWISE = ("mse", "rmse", "mae", "mape", "wmape", "accuracy")


def long_scores(df: DataFrame, columns: Sequence[str], names: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, metric, column, value) of pointwise metrics."""
    wide = df.groupBy(*groups).agg(*pointwise(columns, names))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(c).alias("column"), F.col(f"{n}__{c}").cast("double").alias("value")) for n in names for c in columns])
    return wide.select(*groups, F.inline(rows))


def _pairs(df: DataFrame, c: str, groups: Sequence[str]) -> DataFrame:
    x, y, m = _xy(c)
    return df.where(m).select(*groups, x.cast("double").alias("x"), y.cast("double").alias("y"))


def _sides(df: DataFrame, c: str, groups: Sequence[str]) -> DataFrame:
    """(groups, side, v): truth as side 1, imputed as side -1."""
    return _pairs(df, c, groups).select(*groups, F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("x").alias("v")), F.struct(F.lit(-1).alias("side"), F.col("y").alias("v")))))


def wasserstein(df: DataFrame, c: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean distance of equally ranked values (both sides have the same number)."""
    s = _sides(df, c, groups)
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy(*groups, "side").orderBy("v")))
    paired = ranked.groupBy(*groups, "r").agg(F.sum(F.col("side") * F.col("v")).alias("d"))
    return paired.groupBy(*groups).agg(F.avg(F.abs("d")).alias("value"))


def ks(df: DataFrame, c: str, groups: Sequence[str] = ()) -> DataFrame:
    """Largest distance of the two distribution functions."""
    steps = _sides(df, c, groups).groupBy(*groups, "v").agg(F.sum("side").alias("d"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*groups)
    gap = steps.select(*groups, F.abs(F.sum("d").over(run)).alias("_gap"), F.sum("n").over(every).alias("_n"))
    return gap.groupBy(*groups).agg((F.max("_gap") / (F.max("_n") / 2)).alias("value"))


def total_variation(df: DataFrame, c: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sum over values of the difference of their shares."""
    x, y, m = _xy(c)
    one = df.where(m).select(*groups, F.inline(F.array(F.struct(F.lit(1).alias("side"), x.cast("string").alias("v")), F.struct(F.lit(-1).alias("side"), y.cast("string").alias("v")))))
    counts = one.groupBy(*groups, "v").agg(F.sum("side").alias("d"), F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*groups).agg((F.sum(F.abs("d")) / (F.sum("n") / 2)).alias("value"))


def kl_histogram(df: DataFrame, c: str, groups: Sequence[str] = (), bins: int = 19) -> DataFrame:
    """KL of histograms over ``bins`` equal ranges of both sides' values, each density raised by the machine epsilon."""
    s = _sides(df, c, groups)
    w = Window.partitionBy(*groups)
    lo, width = F.min("v").over(w), (F.max("v").over(w) - F.min("v").over(w)) / bins
    slot = F.when(F.col("width") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    binned = s.withColumns({"lo": lo, "width": width}).withColumn("k", slot)
    counts = binned.groupBy(*groups, "k").agg(F.sum((F.col("side") > 0).cast("double")).alias("a"), F.sum((F.col("side") < 0).cast("double")).alias("b"), F.max("width").alias("_w"))
    total = Window.partitionBy(*groups)
    # Empty bins add the same epsilon on both sides: nothing to the sum, and bins * eps to the norms.
    p, q = (F.col(k) / F.sum(k).over(total) + EPS * F.col("_w") for k in "ab")
    terms = counts.select(*groups, p.alias("p"), q.alias("q"))
    return terms.groupBy(*groups).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("value"))


def energy(df: DataFrame, c: str, groups: Sequence[str] = ()) -> DataFrame:
    """2 S(x, y) - S(x, x) - S(y, y) with S the sum of distances over all pairs, by ranks."""
    s = _sides(df, c, groups)
    r = lambda *by: F.row_number().over(Window.partitionBy(*groups, *by).orderBy("v"))
    n = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*groups, *by))
    ranked = s.select(*groups, "v", (2 * r() - n() - 1).alias("all"), (2 * r("side") - n("side") - 1).alias("own"))
    # Sum over ordered pairs = 2 * sum (2 i - n - 1) v; the union's holds x-x, y-y and twice x-y.
    return ranked.groupBy(*groups).agg((2 * F.sum(F.col("all") * F.col("v")) - 4 * F.sum(F.col("own") * F.col("v"))).alias("value"))


def pairwise_l1(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sum of city-block distances between true and imputed rows that have any masked cell."""
    some = df.where(reduce(lambda a, b: a | b, [F.col(MASK + c) for c in columns]))
    parts = None
    for c in columns:
        whole = some.withColumn(MASK + c, F.lit(True))
        s = _sides(whole, c, groups)
        r = lambda *by: F.row_number().over(Window.partitionBy(*groups, *by).orderBy("v"))
        n = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*groups, *by))
        ranked = s.select(*groups, "v", (2 * r() - n() - 1).alias("all"), (2 * r("side") - n("side") - 1).alias("own"))
        one = ranked.groupBy(*groups).agg((F.sum(F.col("all") * F.col("v")) - F.sum(F.col("own") * F.col("v"))).alias("value"))
        parts = one if parts is None else parts.unionAll(one)
    return parts.groupBy(*groups).agg(F.sum("value").alias("value"))


def _full_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(MASK + c) for c in columns]))


def correlation_difference(df: DataFrame, columns: Sequence[str], use_p_value: bool = True) -> dict[str, float]:
    """By column the mean absolute difference of its correlations' p-values (or the correlations) over fully masked rows."""
    full, pairs = _full_rows(df, columns), [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [F.corr(a + s, b + s).alias(f"r{k}_{i}") for i, (a, b) in enumerate(pairs) for k, s in enumerate(("", SUFFIX))]
    row = full.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    diff = {}
    for i, (a, b) in enumerate(pairs):
        v = [1.0 if a == b else (row[f"r{k}_{i}"] if row[f"r{k}_{i}"] is not None else float("nan")) for k in (0, 1)]
        if use_p_value:
            v = [special.pearson_p(r, row["n"]) for r in v]
        diff[a, b] = diff[b, a] = abs(v[0] - v[1])
    return {a: float(np.mean([diff[a, b] for b in columns])) for a in columns}


def chi2(table: np.ndarray) -> tuple[float, float]:
    """Chi-squared statistic (Yates-corrected for 2 x 2) and its p-value."""
    e = np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()
    df = (table.shape[0] - 1) * (table.shape[1] - 1)
    if df == 0:
        return 0.0, 1.0
    d = np.abs(table - e)
    if df == 1:
        d = np.maximum(d - np.minimum(0.5, d), 0)
    x = float((d**2 / e).sum())
    return x, special.chi2_sf(x, df)


def categorical_difference(df: DataFrame, columns: Sequence[str], use_p_value: bool = True) -> dict[str, float]:
    """As ``correlation_difference`` with chi-squared tests between categorical columns."""
    full, diff = _full_rows(df, columns), {}
    for i, a in enumerate(columns):
        for b in columns[i:]:
            v = []
            for s in ("", SUFFIX):
                t = full.groupBy(F.col(a + s).alias("a"), F.col(b + s).alias("b")).count().toPandas()
                v.append(chi2(t.pivot_table(index="a", columns="b", values="count", fill_value=0).to_numpy(float))[int(use_p_value)])
            diff[a, b] = diff[b, a] = abs(v[0] - v[1])
    return {a: float(np.mean([diff[a, b] for b in columns])) for a in columns}


def anova(rows: list[tuple[float, float, float]]) -> tuple[float, float]:
    """One-way F and its p-value from (n, sum, sum of squares) by class."""
    rows = [r for r in rows if r[0]]
    n, s, q = (sum(r[i] for r in rows) for i in range(3))
    between = sum(r[1] ** 2 / r[0] for r in rows) - s * s / n
    within = q - sum(r[1] ** 2 / r[0] for r in rows)
    d1, d2 = len(rows) - 1, n - len(rows)
    if d1 <= 0 or d2 <= 0:
        return float("nan"), float("nan")
    f = float("inf") if within <= 0 else (between / d1) / (within / d2)
    return f, special.f_sf(f, d1, d2)


def mixed_difference(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], use_p_value: bool = True) -> dict[str, float]:
    """By categorical column the mean difference of one-way ANOVA tests against the numeric columns."""
    full, out = _full_rows(df, [*categories, *numbers]), {}
    full, _ = about_means(full, [c + s for s in ("", SUFFIX) for c in numbers])
    for a in categories:
        got = []
        for s in ("", SUFFIX):
            aggs = [f(v).alias(f"{k}_{c}") for c in numbers for k, f, v in (("n", F.count, F.col(c + s)), ("s", F.sum, F.col(c + s)), ("q", F.sum, F.col(c + s) ** 2))]
            rows = full.groupBy(F.col(a + s).alias("a")).agg(*aggs).collect()
            got.append([anova([(r[f"n_{c}"], r[f"s_{c}"] or 0.0, r[f"q_{c}"] or 0.0) for r in rows])[int(use_p_value)] for c in numbers])
        out[a] = float(np.mean(np.abs(np.array(got[0]) - np.array(got[1]))))
    return out


def mask_pattern(columns: Sequence[str]) -> Column:
    return bits([F.col(MASK + c) for c in columns])


def any_masked(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(MASK + c), F.lit(False)) for c in columns])


def moments(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> pd.DataFrame:
    """n, means and sample covariances of truth and imputed columns by group: one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, s in enumerate(("", SUFFIX)):
        aggs += [F.avg(c + s).alias(f"m{k}_{i}") for i, c in enumerate(columns)]
        aggs += [F.covar_samp(columns[i] + s, columns[j] + s).alias(f"c{k}_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    return df.groupBy(*groups).agg(*aggs).toPandas()


def _gauss(row, k: int, cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([row[f"m{k}_{i}"] for i in cols], float), np.array([[row[f"c{k}_{min(i, j)}_{max(i, j)}"] for j in cols] for i in cols], float)


def _by_pattern(df: DataFrame, columns: Sequence[str], least: int, score: Callable[[pd.Series, list[int]], float]) -> float:
    """Mean over mask patterns with enough rows, weighted by their rows, of a score of the masked columns' moments."""
    m = moments(df.withColumn("_p", mask_pattern(columns)).where(any_masked(columns)), columns, ["_p"])
    good = m[m["n"] >= least]
    if not len(good):
        raise NotEnoughSamples(int(m["n"].max()) if len(m) else 0, least)
    total = m["n"].sum()
    return float(sum(score(r, [i for i in range(len(columns)) if bit_set(r["_p"], i)]) * r["n"] / total for _, r in good.iterrows()))


def kl_gaussian(df: DataFrame, columns: Sequence[str], least: int = 10) -> float:
    return _by_pattern(df, columns, least, lambda r, c: linalg.gaussian_kl(*_gauss(r, 0, c), *_gauss(r, 1, c)))


def _frechet(r, cols: list[int]) -> float:
    (m1, s1), (m2, s2) = _gauss(r, 0, cols), _gauss(r, 1, cols)
    n = r["n"]
    mean = (m1 + m2) / 2
    both = ((n - 1) * (np.diag(s1) + np.diag(s2)) + n * ((m1 - mean) ** 2 + (m2 - mean) ** 2)) / (2 * n - 1)
    sd = np.sqrt(np.where(both > 0, both, 1))
    return linalg.frechet(m1 / sd, s1 / np.outer(sd, sd), m2 / sd, s2 / np.outer(sd, sd)) / len(cols)


def frechet(df: DataFrame, columns: Sequence[str]) -> float:
    """Frechet distance of the two samples of rows with any masked cell, jointly standardised, divided by the columns."""
    row = moments(df.where(any_masked(columns)), columns).iloc[0]
    return _frechet(row, list(range(len(columns))))


def frechet_pattern(df: DataFrame, columns: Sequence[str], least: int = 10) -> float:
    return _by_pattern(df, columns, least, _frechet)


def distance_anticorrelation(x: np.ndarray, y: np.ndarray) -> float:
    """(1 - distance correlation) / 2 of two samples of rows."""
    def centred(v: np.ndarray) -> np.ndarray:
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    var = np.sqrt((a * a).mean() * (b * b).mean())
    return float((1 - np.sqrt(max((a * b).mean(), 0) / var)) / 2) if var > 0 else 0.5


def dist_corr_pattern(df: DataFrame, columns: Sequence[str], least: int = 10, task_rows: int = 5_000) -> float:
    """By mask pattern, weighted by rows; patterns of up to ``task_rows`` rows in a task each, larger ones over all tasks.

    Both ways are exact: ``distances`` has the plan of the larger ones.
    """
    rows = df.withColumn("_p", mask_pattern(columns)).where(any_masked(columns))
    sizes = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
    good = {p: n for p, n in sizes.items() if n >= least}
    if not good:
        raise NotEnoughSamples(max(sizes.values(), default=0), least)

    def masked(p) -> list[str]:
        return [c for i, c in enumerate(columns) if bit_set(p, i)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = masked(pdf["_p"].iloc[0])
        return pd.DataFrame({"_p": pdf["_p"].iloc[:1], "v": [distance_anticorrelation(pdf[cols].to_numpy(float), pdf[[c + SUFFIX for c in cols]].to_numpy(float))]})

    small = [p for p, n in good.items() if n <= task_rows]
    got = {p: distances.distance_anticorrelation(rows.where(F.col("_p") == p), masked(p), [c + SUFFIX for c in masked(p)]) for p in good if good[p] > task_rows}
    if small:
        got |= {r["_p"]: r["v"] for r in rows.where(F.col("_p").isin(small)).groupBy("_p").applyInPandas(run, f"_p {dict(rows.dtypes)['_p']}, v double").collect()}
    return float(sum(v * good[p] for p, v in got.items()) / sum(sizes.values()))


def _each(f: Callable[..., DataFrame]) -> Callable[[DataFrame, Sequence[str]], dict[str, float]]:
    return lambda df, columns: {c: f(df, c).first()["value"] for c in columns}


def _point(name: str) -> Callable[[DataFrame, Sequence[str]], dict[str, float]]:
    return lambda df, columns: {c: v for c, v in zip(columns, df.agg(*pointwise(columns, [name])).first())}


METRICS: dict[str, Callable] = {
    **{n: _point(n) for n in POINTWISE},
    "wasserstein_columnwise": _each(wasserstein), "ks_test": _each(ks), "total_variance_distance": _each(total_variation), "kl_columnwise": _each(kl_histogram),
    "energy": lambda df, cols: {"all": sum(energy(df, c).first()["value"] for c in cols)}, "pairwise_l1": lambda df, cols: {"all": pairwise_l1(df, cols).first()["value"]},
    "correlation_diff": correlation_difference, "kl_gaussian": lambda df, cols: {"all": kl_gaussian(df, cols)}, "frechet": lambda df, cols: {"all": frechet(df, cols)},
    "frechet_pattern": lambda df, cols: {"all": frechet_pattern(df, cols)}, "dist_corr_pattern": lambda df, cols: {"all": dist_corr_pattern(df, cols)},
}


def get_metric(name: str) -> Callable[[DataFrame, Sequence[str]], dict[str, float]]:
    """A metric by name: (scored table, columns) -> value by column, or under ``all``."""
    if name not in METRICS:
        raise LacunaError(f"unknown metric {name}; known are {', '.join(METRICS)}")
    return METRICS[name]
