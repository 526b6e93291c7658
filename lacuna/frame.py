"""Rows made explicit: order, identity and groups of a table, and its missing cells.

A missing cell is NULL, never NaN.  Operators that depend on row order take it as
``order_by``; those that run for each group take ``groups``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from .errors import AllMissingColumn, NotDataFrame, OrderRequired, TypeNotHandled

#: Types an imputed column may have.
HANDLED = (T.NumericType, T.StringType, T.BooleanType)


@dataclass(frozen=True)
class Spec:
    """How rows are ordered, told apart and grouped."""

    order_by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()

    @classmethod
    def of(cls, order_by: Sequence[str] | str = (), key: Sequence[str] | str = (), groups: Sequence[str] | str = ()) -> Spec:
        many = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
        return cls(many(order_by), many(key), many(groups))

    def ordered(self, what: str) -> WindowSpec:
        if not self.order_by:
            raise OrderRequired(what)
        return Window.partitionBy(*self.groups).orderBy(*self.order_by)

    def grouped(self) -> WindowSpec:
        return Window.partitionBy(*self.groups)

    @property
    def reserved(self) -> set[str]:
        return {*self.order_by, *self.key, *self.groups}


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(but)]


def categorical_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in set(but)]


def check_types(df: DataFrame, columns: Sequence[str], handled: tuple[type, ...] = HANDLED) -> None:
    """Raises for the first column whose type is not handled."""
    if not isinstance(df, DataFrame):
        raise NotDataFrame(type(df))
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, handled):
            raise TypeNotHandled(c, kind.simpleString())


def canonical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes NULL in floating columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def observed_counts(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> tuple[int, dict[str, int], dict[str, int]]:
    """Rows; observed cells by column; and the least number of them in any group: one job."""
    per_group = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    row = per_group.agg(F.sum("_n"), *[F.sum(f"_c{i}") for i in range(len(columns))], *[F.min(f"_c{i}") for i in range(len(columns))]).first()
    k = len(columns)
    return row[0] or 0, {c: row[1 + i] or 0 for i, c in enumerate(columns)}, {c: row[1 + k + i] or 0 for i, c in enumerate(columns)}


def check_not_all_missing(rows: int, observed: dict[str, int]) -> None:
    for c, n in observed.items():
        if rows and not n:
            raise AllMissingColumn(c)


def bits(flags: Sequence[Column]) -> Column:
    """Flags as one key: a long with bit i for flag i, or for more than 63 flags a string of 0 and 1."""
    if len(flags) > 63:
        return F.concat(*[F.when(f, "1").otherwise("0") for f in flags])
    out = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        out = out + F.when(f, F.lit(1 << i).cast("long")).otherwise(0)
    return out


def no_bits(n: int) -> Column:
    """The key of ``n`` flags that are all false."""
    return F.lit("0" * n) if n > 63 else F.lit(0).cast("long")


def bit_set(key: int | str, i: int) -> bool:
    return key[i] == "1" if isinstance(key, str) else bool(int(key) >> i & 1)


def pattern(columns: Sequence[str]) -> Column:
    """The missingness pattern of a row: flag i is set where column i is missing."""
    return bits([F.col(c).isNull() for c in columns])


def about_means(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """``df`` with columns less their means, as doubles, and the means: sums of products then do not cancel."""
    means = [m or 0.0 for m in df.agg(*[F.avg(c) for c in columns]).first()] if columns else []
    return df.withColumns({c: F.col(c).cast("double") - m for c, m in zip(columns, means)}), means
