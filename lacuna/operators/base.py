"""The contract of every imputer.

``fit`` looks at a table and returns a fitted ``Model``; ``Model.transform``
fills NULL cells of the fitted columns and touches no other cell.  A cell that
the method leaves missing takes the median (numbers) or the most frequent value,
the smallest of equals (others), of the column as it then is, over all groups.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SchemaChanged
from ..frame import Spec, canonical, check_not_all_missing, check_types, is_numeric, observed_counts


#: The column that holds a user's columns while an imputer works.
REST = "_lacuna_rest"


class Model:
    """A fitted imputer."""

    def __init__(self, imputer: Imputer, columns: list[str], schema: list[tuple[str, str]], fill: Callable[[DataFrame], DataFrame], whole: bool):
        self.imputer, self.columns, self.schema, self._fill, self._whole = imputer, columns, schema, fill, whole

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its missing cells of the fitted columns filled."""
        now = dict(df.dtypes)
        for name, kind in self.schema:
            if now.get(name) != kind:
                raise SchemaChanged(f"column {name} is {now.get(name)}; it was {kind} when the imputer was fitted")
        if not self.columns:
            return df
        rest = self.imputer.passengers(df)
        rows = df.select(*[F.col(c) for c in df.columns if c not in rest], F.struct(*rest).alias(REST)) if rest else df
        filled = self._fill(canonical(rows, self.columns))
        filled = filled if self._whole else fallback(filled, self.columns)
        return filled.select(*[F.col(REST)[c].alias(c) if c in rest else F.col(c) for c in df.columns]) if rest else filled


class Imputer:
    """Base of all imputers; subclasses give ``_fit``.

    ``hyper`` holds parameters by name; ``name/column`` overrides ``name`` for
    one column.
    """

    needs_order = False
    #: Rows of the table fitted last.
    rows = 0

    def __init__(self, groups: Sequence[str] = (), order_by: Sequence[str] = (), key: Sequence[str] = (), columns: Sequence[str] | None = None, seed: int = 0, **hyper: Any):
        self.spec = Spec.of(order_by, key, groups)
        self.columns, self.seed, self.hyper = columns, seed, hyper

    def param(self, name: str, column: str | None = None, default: Any = None) -> Any:
        if column is not None and f"{name}/{column}" in self.hyper:
            return self.hyper[f"{name}/{column}"]
        return self.hyper.get(name, default)

    def with_params(self, **hyper: Any) -> Imputer:
        """A copy with some parameters changed."""
        out = copy.copy(self)
        out.hyper = self.hyper | hyper
        return out

    def targets(self, df: DataFrame) -> list[str]:
        return list(self.columns) if self.columns is not None else [c for c in df.columns if c not in self.spec.reserved]

    def passengers(self, df: DataFrame) -> list[str]:
        """Columns that the imputer does not use and whose names might be those of its own inner columns; they travel as one struct."""
        used = {*self.targets(df), *self.spec.reserved, *[v for v in self.hyper.values() if isinstance(v, str)]}
        return [c for c in df.columns if c.startswith("_") and c not in used] if self.columns is not None else []

    def fit(self, df: DataFrame) -> Model:
        if self.needs_order:
            self.spec.ordered(type(self).__name__)
        targets = self.targets(df)
        check_types(df, targets)
        clean = canonical(df.drop(*self.passengers(df)), targets)
        rows, seen, least = observed_counts(clean, targets, self.spec.groups)
        check_not_all_missing(rows, seen)
        holes, self.rows = [c for c in targets if seen[c] < rows], rows
        fill = self._fit(clean, holes, targets)
        whole = self.leaves_none and all(least[c] for c in holes)
        return Model(self, holes, [(c, t) for c, t in df.dtypes if c in targets], fill, whole)

    #: Whether a group with at least one observed cell is filled entirely.
    leaves_none = True

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Callable[[DataFrame], DataFrame]:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def fallback(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fills what is left by one value for each column: a one-row table, hence broadcast."""
    numbers = [c for c in columns if is_numeric(df, c)]
    stats = df.agg(F.lit(1).alias("_one"), *[F.median(c).alias(f"_f_{c}") for c in numbers])
    for c in columns:
        if c not in numbers:
            top = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min(F.struct(-F.col("count"), F.col(c))).alias("m")).select(F.col(f"m.{c}").alias(f"_f_{c}"))
            stats = stats.crossJoin(top)
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[F.coalesce(F.col(c), F.col(f"_f_{c}").cast(df.schema[c].dataType)).alias(c) if c in set(columns) else F.col(c) for c in df.columns])


def replace(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with NULL cells of some columns taken from expressions, in the column's type."""
    wide = {"int": "double", "bigint": "double", "smallint": "double", "tinyint": "double"}

    def cell(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        kind = wide.get(kind, kind)
        return F.coalesce(F.col(c).cast(kind), values[c].cast(kind)).alias(c)

    return df.select(*[cell(c) if c in values else F.col(c) for c in df.columns])


def mode_by(df: DataFrame, column: str, groups: Sequence[str]) -> DataFrame:
    """(groups, _mode): the most frequent value, of equals the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*groups).agg(F.min(F.struct(-F.col("_n"), F.col(column).alias("v"))).alias("_m"))
    return best.select(*groups, F.col("_m.v").alias("_mode"))


def join_groups(df: DataFrame, table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Left join on group columns where NULL groups meet; a cross join with the one row where there are none."""
    if not groups:
        return df.crossJoin(F.broadcast(table))
    renamed = table.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    condition = [df[g].eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return df.join(renamed, condition, "left").drop(*[f"_g_{g}" for g in groups])


def everything(spec: Spec):
    return Window.partitionBy(*spec.groups).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
