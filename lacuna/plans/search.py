"""Hyper-parameter search by a tree-structured Parzen estimator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand
from ..operators.base import Imputer
from ..operators.holes import MASK, hide
from ..operators.metrics import SUFFIX, get_metric

#: How the columns begin in which truth and masks travel through an imputer.
KEPT = "_lacuna_kept_"

#: A parameter's space: ("uniform", low, high), ("loguniform", low, high), ("int", low, high) or ("choice", values).
Space = dict[str, tuple]


def draw(kind: tuple, rng: np.random.Generator) -> object:
    name, *arg = kind
    if name == "choice":
        return arg[0][int(rng.integers(len(arg[0])))]
    if name == "int":
        return int(rng.integers(arg[0], arg[1] + 1))
    if name == "loguniform":
        return float(np.exp(rng.uniform(np.log(arg[0]), np.log(arg[1]))))
    return float(rng.uniform(arg[0], arg[1]))


def _propose(kind: tuple, good: list, bad: list, rng: np.random.Generator, tries: int = 24) -> object:
    """The candidate, drawn around good values, whose density among good values is largest against that among bad ones."""
    name, *arg = kind
    if name == "choice":
        w = np.array([(1 + good.count(v)) / (1 + bad.count(v)) for v in arg[0]])
        return arg[0][int(rng.choice(len(w), p=w / w.sum()))]
    to = np.log if name == "loguniform" else np.asarray
    lo, hi = float(to(arg[0])), float(to(arg[1]))
    g, b = to(np.array(good, float)), to(np.array(bad, float))
    width = max((hi - lo) / max(len(good), 1) ** 0.5 / 2, 1e-9)

    def density(x: float, points: np.ndarray) -> float:
        return float(np.exp(-0.5 * ((x - points) / width) ** 2).sum() / width + 1 / (hi - lo + 1e-12)) / (len(points) + 1)

    cand = np.clip(rng.choice(g, tries) + width * rng.normal(size=tries), lo, hi)
    x = float(max(cand, key=lambda v: density(v, g) / density(v, b)))
    return int(round(x)) if name == "int" else float(np.exp(x)) if name == "loguniform" else x


def minimize(objective: Callable[[dict], float], space: Space, max_evals: int = 10, seed: int = 0, warm: int = 4) -> tuple[dict, float]:
    rng, tried = rand.generator("search", seed), []
    for n in range(max_evals):
        if n < warm:
            params = {k: draw(v, rng) for k, v in space.items()}
        else:
            ranked = sorted(tried, key=lambda t: t[1])
            cut = max(2, len(ranked) // 4)
            params = {k: _propose(v, [t[0][k] for t in ranked[:cut]], [t[0][k] for t in ranked[cut:]], rng) for k, v in space.items()}
        tried.append((params, objective(params)))
    return min(tried, key=lambda t: t[1])


def refilled(imputer: Imputer, fold: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``fold`` with what the imputer makes of its columns, masked cells hidden, as ``c<suffix>``.

    An imputer that is told its columns takes truth and masks along on their rows, so
    no join brings them back; else rows meet by their key.
    """
    source = [c for c in fold.columns if not c.startswith(MASK) and c != "fold"]
    made = [F.col(c).alias(c + SUFFIX) for c in columns]
    if imputer.columns is not None:
        kept = [*columns, *[c for c in fold.columns if c.startswith(MASK)]]
        hidden = hide(fold.withColumns({KEPT + c: F.col(c) for c in kept}), columns).select(*source, *[KEPT + c for c in kept])
        rest = [c for c in source if c not in set(columns)]
        return imputer.fit_transform(hidden).select(*rest, *[F.col(KEPT + c).alias(c) for c in kept], *made)
    key = list(imputer.spec.key or imputer.spec.order_by)
    filled = imputer.fit_transform(hide(fold, columns).select(*source)).select(*[F.col(k).alias(f"_k_{k}") for k in key], *made)
    return fold.join(filled, [fold[k].eqNullSafe(F.col(f"_k_{k}")) for k in key]).drop(*[f"_k_{k}" for k in key])


def objective_of(imputer: Imputer, masked: DataFrame, columns: Sequence[str], metric: str) -> Callable[[dict], float]:
    """The mean over folds and columns of a metric, as a function of parameters."""
    folds = [r["fold"] for r in masked.select("fold").distinct().orderBy("fold").collect()]

    def value(params: dict) -> float:
        got = []
        for f in folds:
            both = refilled(imputer.with_params(**params), masked.where(F.col("fold") == f), columns)
            got += [v for v in get_metric(metric)(both, columns).values() if v is not None]
        return float(np.mean(got))

    return value


def optimize(imputer: Imputer, masked: DataFrame, columns: Sequence[str], metric: str, space: Space, max_evals: int = 10) -> Imputer:
    """A tuned copy; with nothing to search, an untouched one."""
    if not space:
        return imputer.with_params()
    best, _ = minimize(objective_of(imputer, masked, columns, metric), space, max_evals, imputer.seed)
    return imputer.with_params(**best)
