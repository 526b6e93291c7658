"""Cross-validated comparison of imputers on artificial holes."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import Imputer
from ..operators.holes import MASK, HoleGenerator
from ..operators.metrics import POINTWISE, get_metric, long_scores
from ..storage import Scratch
from .search import optimize, refilled


class Comparator:
    """Scores each imputer by each metric on the cells that a generator hides.

    Masks of all folds are stored once, on their rows.  Each imputer's tasks are
    submitted from a driver thread, so Spark's scheduler fills the cluster with
    several at a time.  All pointwise metrics of all columns are one aggregate.
    """

    def __init__(self, models: dict[str, Imputer], generator: HoleGenerator, metrics: Sequence[str] = ("mae", "wmape", "ks_test"), search: dict[str, dict] | None = None, metric_optim: str = "mse", max_evals: int = 10):
        self.models, self.generator, self.metrics = models, generator, list(metrics)
        self.search, self.metric_optim, self.max_evals = search or {}, metric_optim, max_evals

    def folds(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        masked = Scratch(df.sparkSession).save(self.generator.split(df), "folds")
        return masked, [c[len(MASK) :] for c in masked.columns if c.startswith(MASK)]

    def errors(self, model: Imputer, fold: DataFrame, columns: Sequence[str]) -> DataFrame:
        """(metric, column, value) of one imputer on one masked table."""
        both = refilled(model, fold, columns)
        point = [m for m in self.metrics if m in POINTWISE]
        rows = long_scores(both, columns, point) if point else None
        rest = [(m, c, None if v is None else float(v)) for m in self.metrics if m not in POINTWISE for c, v in get_metric(m)(both, columns).items()]
        if rest:
            extra = fold.sparkSession.createDataFrame(rest, "metric string, column string, value double")
            rows = extra if rows is None else rows.unionByName(extra)
        return rows

    def compare(self, df: DataFrame, n_jobs: int = 4) -> DataFrame:
        """(metric, column) rows with one value column for each imputer: the mean over folds."""
        masked, columns = self.folds(df)
        spark = df.sparkSession

        def one(item: tuple[str, Imputer]) -> list[tuple]:
            name, model = item
            if name in self.search:
                model = optimize(model, masked, columns, self.metric_optim, self.search[name], self.max_evals)
            return [(name, r["metric"], r["column"], r["value"]) for f in range(self.generator.n_splits) for r in self.errors(model, masked.where(F.col("fold") == f), columns).collect()]

        with ThreadPoolExecutor(max(1, min(n_jobs, len(self.models)))) as pool:
            rows = [r for part in pool.map(one, self.models.items()) for r in part]
        table = spark.createDataFrame(rows, "imputer string, metric string, column string, value double")
        return table.groupBy("metric", "column").pivot("imputer", list(self.models)).agg(F.avg("value"))


def rank_imputers(scores: DataFrame, metric: str, column: str) -> list[str]:
    """Imputers from best to worst by one error metric."""
    row = scores.where((F.col("metric") == metric) & (F.col("column") == column)).drop("metric", "column").first()
    return [k for k, v in sorted(row.asDict().items(), key=lambda x: (x[1] is None, x[1]))]


