"""Regression imputation: closed-form linear models from Gram matrices, bagged trees, chained equations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EstimatorNotDefined, LacunaError
from ..frame import about_means, numeric_columns
from ..functions import rand
from .base import Imputer, join_groups, replace
from .chained import chained
from .simple import per_group

Fill = Callable[[DataFrame], DataFrame]


def gram_columns(features: Sequence[str], target: str, rows: Column) -> list[Column]:
    """Sums that make up X'X and X'y with an intercept, over the rows where ``rows`` holds."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    out = [F.sum(F.when(rows, x[i] * x[j])).alias(f"g_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return out + [F.sum(F.when(rows, a * F.col(target).cast("double"))).alias(f"b_{i}") for i, a in enumerate(x)] + [F.sum(F.when(rows, F.col(target).cast("double") ** 2)).alias("yy")]


def solve(row: dict, k: int, ridge: float = 0.0, bayes: bool = False) -> np.ndarray | None:
    """Coefficients (intercept first) from the sums of ``gram_columns``; None without rows.

    ``bayes`` finds ridge and noise by evidence iteration on the centred sums.
    """
    if row["g_0_0"] is None:
        return None
    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
    b = np.array([row[f"b_{i}"] for i in range(k + 1)], float)
    n = g[0, 0]
    if not bayes:
        return np.linalg.pinv(g + np.diag([0.0] + [ridge] * k), rcond=1e-12) @ b
    mean, my = g[0, 1:] / n, b[0] / n
    gc, bc, yc = g[1:, 1:] - n * np.outer(mean, mean), b[1:] - n * mean * my, max(row["yy"] - n * my * my, 0.0)
    if not k:
        return np.array([my])
    w, v = np.linalg.eigh(gc)
    w = np.maximum(w, 0)
    alpha, lam = 1 / max(yc / n, 1e-12), 1.0
    coef = np.zeros(k)
    for _ in range(300):
        new = v @ ((v.T @ bc) * alpha / (alpha * w + lam))
        gamma = (alpha * w / (lam + alpha * w)).sum()
        rss = max(yc - 2 * new @ bc + new @ gc @ new, 0.0)
        lam = (gamma + 2e-6) / ((new**2).sum() + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        if np.abs(new - coef).sum() < 1e-3:
            coef = new
            break
        coef = new
    return np.concatenate([[my - mean @ coef], coef])


def linear(features: Sequence[str], coef: Column | Sequence[float], means: dict[str, float]) -> Column:
    """Intercept plus coefficients times features less their means; NULL where a feature is."""
    get = (lambda i: coef[i]) if isinstance(coef, Column) else (lambda i: F.lit(float(coef[i])))
    out = get(0)
    for i, c in enumerate(features):
        out = out + get(i + 1) * (F.col(c).cast("double") - means.get(c, 0.0))
    return out


class ImputerRegressor(Imputer):
    """Each incomplete column is regressed on the others, in each group by its own model.

    ``estimator``: ols (default), ridge, bayes (one aggregate gives the Gram
    matrices of all groups), or trees (bagged, in one task for each group), or an
    object with fit(X, y) and predict(X).  ``handler_nan``: row learns from and
    predicts complete rows only; column uses complete columns only; none or fit
    leaves missing features to the estimator (trees and objects).
    """

    leaves_none = False

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        kind, handler = self.param("estimator", default="ols"), self.param("handler_nan", default="row")
        if kind is None:
            raise EstimatorNotDefined("an estimator is needed")
        numbers = [c for c in numeric_columns(df) if c in targets]
        groups, ridge = self.spec.groups, float(self.param("ridge", default=1.0 if kind == "ridge" else 0.0))
        if kind not in ("ols", "ridge", "bayes"):
            make = (lambda: Bagged(seed=self.seed)) if kind == "trees" else (lambda: kind)
            return per_group(self, [c for c in holes if c in numbers], lambda pdf, cols: _regress_group(pdf, cols, numbers, make, handler))
        plans = []
        about, middle = about_means(df, [c for c in numbers if c not in groups])
        means = dict(zip([c for c in numbers if c not in groups], middle))
        for c in [c for c in holes if c in numbers]:
            features = [x for x in numbers if x != c and (handler != "column" or x not in holes)]
            rows = F.col(c).isNotNull()
            for x in features:
                rows = rows & F.col(x).isNotNull()
            sums = about.groupBy(*groups).agg(*gram_columns(features, c, rows))
            if groups:
                plans.append((c, features, _solved_by_group(sums, groups, len(features), ridge, kind == "bayes", c)))
            else:
                coef = solve(sums.first().asDict(), len(features), ridge, kind == "bayes")
                plans.append((c, features, coef))

        def fill(d: DataFrame) -> DataFrame:
            out, values = d, {}
            for c, features, model in plans:
                if isinstance(model, DataFrame):
                    out = join_groups(out, model, groups)
                    values[c] = linear(features, F.col(f"_c_{c}"), means) + means.get(c, 0.0)
                elif model is not None:
                    values[c] = linear(features, model, means) + means.get(c, 0.0)
            return replace(out, values).select(*d.columns)

        return fill


def _solved_by_group(sums: DataFrame, groups: Sequence[str], k: int, ridge: float, bayes: bool, column: str) -> DataFrame:
    """(groups, _c_<column>): a row of sums for each group becomes its coefficients, where the row is."""

    def run(batches):
        for pdf in batches:
            coef = [solve({n: (None if pd.isna(v) else v) for n, v in r.items()}, k, ridge, bayes) for r in pdf.to_dict("records")]
            yield pdf[list(groups)].assign(**{f"_c_{column}": [None if c is None else c.tolist() for c in coef]})

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    return sums.mapInPandas(run, ", ".join(f"`{g}` {kinds[g]}" for g in groups) + f", `_c_{column}` array<double>")


def _regress_group(pdf: pd.DataFrame, columns: list[str], numbers: list[str], make, handler: str) -> pd.DataFrame:
    done = pdf.copy()
    for c in columns:
        features = [x for x in numbers if x != c and (handler != "column" or pdf[x].notna().all())]
        x, y = pdf[features].to_numpy(float), pdf[c].to_numpy(float)
        whole = ~np.isnan(x).any(axis=1) if handler == "row" else np.ones(len(pdf), bool)
        learn, ask = whole & ~np.isnan(y), whole & np.isnan(y)
        if learn.any() and ask.any() and features:
            model = make()
            model.fit(x[learn], y[learn])
            done.loc[ask, c] = np.asarray(model.predict(x[ask]), float)
    return done


class Bagged:
    """Regression trees on bootstrap samples, split at quantile bins; missing features go left."""

    def __init__(self, n_trees: int = 50, depth: int = 8, least: int = 2, bins: int = 32, seed: int = 0, bootstrap: bool = True):
        self.n_trees, self.depth, self.least, self.bins, self.seed, self.bootstrap = n_trees, depth, least, bins, seed, bootstrap

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.where(np.isnan(v), 0, np.searchsorted(c, v, side="left") + 1) for v, c in zip(x.T, self.cuts)], axis=1)

    def _grow(self, codes: np.ndarray, y: np.ndarray, depth: int):
        n, total = len(y), y.sum()
        if depth == 0 or n < self.least or np.ptp(y) == 0:
            return float(total / n)
        best = None
        for j in range(codes.shape[1]):
            count = np.cumsum(np.bincount(codes[:, j], minlength=self.bins + 1))[:-1]
            part = np.cumsum(np.bincount(codes[:, j], y, self.bins + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((count > 0) & (count < n), part**2 / count + (total - part) ** 2 / (n - count), -np.inf)
            k = int(gain.argmax())
            if gain[k] > -np.inf and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k)
        if best is None:
            return float(total / n)
        _, j, k = best
        left = codes[:, j] <= k
        return j, k, self._grow(codes[left], y[left], depth - 1), self._grow(codes[~left], y[~left], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Bagged:
        rng = rand.generator("bagged", self.seed, x.shape)
        grid = np.linspace(0, 1, self.bins)[1:-1]
        self.cuts = []
        for v in x.T:
            seen = np.unique(v[~np.isnan(v)])
            self.cuts.append((seen[:-1] + seen[1:]) / 2 if len(seen) < self.bins else np.unique(np.quantile(seen, grid)))
        codes = self._codes(x)
        self.trees, self.oob = [], np.zeros((2, len(y)))
        for _ in range(self.n_trees):
            rows = rng.integers(0, len(y), len(y)) if self.bootstrap else np.arange(len(y))
            tree = self._grow(codes[rows], y[rows], self.depth)
            self.trees.append(tree)
            if self.bootstrap:
                out = np.bincount(rows, minlength=len(y)) == 0
                self.oob[0, out] += self._ask(tree, codes[out])
                self.oob[1, out] += 1
        return self

    def _ask(self, tree, codes: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(codes), tree)
        j, k, a, b = tree
        left = codes[:, j] <= k
        out = np.empty(len(codes))
        out[left], out[~left] = self._ask(a, codes[left]), self._ask(b, codes[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return np.mean([self._ask(t, codes) for t in self.trees], axis=0)

    def out_of_bag(self) -> np.ndarray:
        """Mean prediction of the trees that did not see a row; NaN where all did."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.oob[0] / self.oob[1]


class ImputerMICE(Imputer):
    """Chained equations: holes start at the group's mean, then each column in turn, fewest holes first, is regressed on all others.

    ``estimator``: bayes (default), ols or ridge run over all groups at once, one
    aggregate a column and sweep, the state stored once a sweep; for trees each
    group is one task.  Stops when no cell moves by more than ``tolerance`` times
    the largest absolute value, or after ``max_iter`` sweeps.

    ``sample_posterior`` draws coefficients and cells from their posterior laws in
    place of means, in each of ``max_iter`` sweeps (10 unless given); draws are keyed
    by row, so ``key`` is needed.  Different seeds give multiple imputations.
    """

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Fill:
        kind, draws = self.param("estimator", default="bayes"), bool(self.param("sample_posterior", default=False))
        most, tol = int(self.param("max_iter", default=10 if draws else 100)), float(self.param("tolerance", default=1e-3))
        numbers = [c for c in numeric_columns(df) if c in targets]
        cols, keys = [c for c in holes if c in numbers], self.spec.key or self.spec.order_by
        if kind not in ("bayes", "ols", "ridge"):
            if draws:
                raise EstimatorNotDefined(f"{kind} has no posterior to draw from")
            return per_group(self, cols, lambda pdf, c: _chain_group(pdf, c, numbers, most, tol, self.seed))
        if draws and not keys:
            raise LacunaError("draws are keyed by row: give key")
        return lambda d: chained(d, cols, numbers, self.spec.groups, kind, most, tol, draws, keys, self.seed)


def _chain_group(pdf: pd.DataFrame, columns: list[str], numbers: list[str], most: int, tol: float, seed: int) -> pd.DataFrame:
    """Chained equations of one group by bagged trees."""
    x = pdf[numbers].to_numpy(float)
    hole = np.isnan(x)
    means = np.array([np.nanmean(v) if not h.all() else 0.0 for v, h in zip(x.T, hole.T)])
    z = np.where(hole, means, x)
    order = sorted((j for j in range(len(numbers)) if hole[:, j].any() and not hole[:, j].all()), key=lambda j: hole[:, j].sum())
    for _ in range(most):
        before = z.copy()
        for j in order:
            rest = np.delete(z, j, axis=1)
            z[hole[:, j], j] = Bagged(seed=seed, n_trees=20).fit(rest[~hole[:, j]], z[~hole[:, j], j]).predict(rest[hole[:, j]])
        if np.abs(z - before).max(initial=0) < tol * np.abs(x[~hole]).max(initial=0):
            break
    pdf[numbers] = z
    return pdf


__all__ = ["Bagged", "ImputerMICE", "ImputerRegressor", "gram_columns", "linear", "solve"]
