"""Mixed-type preprocessing: snapping to known values, one-hot columns, wrapped imputers, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import TypeNotHandled
from ..frame import categorical_columns, is_numeric, numeric_columns
from .base import Imputer


class BinTransformer:
    """Snaps numbers to the nearest value seen at fit; half-way goes up.  Its inverse is itself.

    The known values of a column are kept as a table of ranges and met by a range
    join on a sort key, so their number is not limited by the driver.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns, self.tables = list(columns), {}

    def fit(self, df: DataFrame) -> BinTransformer:
        for c in self.columns:
            values = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull()).distinct()
            w = Window.orderBy("v")
            self.tables[c] = values.select("v", ((F.lag("v").over(w) + F.col("v")) / 2).alias("lo"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            # The last range start at or below the value: a running maximum over the union of both.
            rows = out.withColumn("_id", F.monotonically_increasing_id())
            starts = self.tables[c].select(F.coalesce("lo", F.lit(float("-inf"))).alias("x"), F.col("v").alias("snap"), F.lit(None).cast("long").alias("_id"))
            both = starts.unionByName(rows.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), F.lit(None).cast("double").alias("snap"), "_id"))
            w = Window.orderBy("x", F.col("_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
            found = both.withColumn("snap", F.last("snap", True).over(w)).where(F.col("_id").isNotNull()).select("_id", "snap")
            out = rows.join(found, "_id", "left").select(*[F.coalesce("snap", F.col(c).cast("double")).alias(c) if x == c else F.col(x) for x in out.columns])
        return out

    inverse_transform = transform


class OneHot:
    """A 0/1 column for each value; ``reverse`` takes the value with the largest column, of equals the last."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.values = list(columns), {}

    def name(self, c: str, v: object) -> str:
        return f"{c}={v}"

    def fit(self, df: DataFrame) -> OneHot:
        for c in self.columns:
            self.values[c] = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.columns]
        return df.select(*keep, *[(F.col(c) == v).cast("double").alias(self.name(c, v)) for c in self.columns for v in self.values[c]])

    def reverse(self, df: DataFrame) -> DataFrame:
        made, gone = [], set()
        for c in self.columns:
            names = [self.name(c, v) for v in self.values[c]]
            gone |= set(names)
            top = F.greatest(*[F.col(f"`{n}`") for n in names], F.lit(float("-inf")))
            pick = F.lit(None)
            for n, v in zip(names, self.values[c]):
                pick = F.when(F.col(f"`{n}`") == top, F.lit(v)).otherwise(pick)
            made.append(pick.alias(c))
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *made)


class WrapperTransformer:
    """An imputer between a transformation and its inverse."""

    def __init__(self, imputer: Imputer, wrapper: OneHot):
        self.imputer, self.wrapper = imputer, wrapper

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.wrapper.reverse(self.imputer.fit_transform(self.wrapper.fit(df).transform(df)))


def preprocessing_stages(df: DataFrame, target: str, scale_numerical: bool = False, but: Sequence[str] = ()) -> tuple[list, str]:
    """Spark ML stages that turn the other columns into one vector: numbers (scaled if asked) and indexed categories, NULL kept apart."""
    numbers = [c for c in numeric_columns(df, [target, *but])]
    categories = [c for c in categorical_columns(df, [target, *but])]
    stages = [StringIndexer(inputCol=c, outputCol=f"_x_{c}", handleInvalid="keep") for c in categories]
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"_x_{c}" for c in categories]], outputCol="_features", handleInvalid="keep"))
    if scale_numerical:
        stages.append(StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True))
    return stages, "_scaled" if scale_numerical else "_features"


class MixteHGBM:
    """Boosted trees by Spark ML: a regressor for numbers, a classifier for strings (a forest for more than two classes).

    Missing features take -1e9, so that a split can part them from all values.
    """

    def __init__(self, **params):
        self.params = {"maxIter": 20, "maxDepth": 4, "seed": 0} | params

    def set_model_parameters(self, **params) -> MixteHGBM:
        self.params |= params
        return self

    def fit(self, df: DataFrame, target: str, scale_numerical: bool = False, but: Sequence[str] = ()) -> MixteHGBM:
        self.target, self.but = target, list(but)
        kind = df.schema[target].dataType
        if not isinstance(kind, (T.NumericType, T.StringType)):
            raise TypeNotHandled(target, kind.simpleString())
        known = self._ready(df.where(F.col(target).isNotNull()))
        stages, features = preprocessing_stages(known, target, scale_numerical, but)
        if is_numeric(df, target):
            model, self.labels = GBTRegressor(featuresCol=features, labelCol=target, **self.params), None
        else:
            index = StringIndexer(inputCol=target, outputCol="_y").fit(known)
            self.labels = index.labels
            known = index.transform(known)
            rest = {k: v for k, v in self.params.items() if k != "maxIter"}
            model = GBTClassifier(featuresCol=features, labelCol="_y", **self.params) if len(self.labels) == 2 else RandomForestClassifier(featuresCol=features, labelCol="_y", **rest)
        self.model = Pipeline(stages=[*stages, model]).fit(known)
        return self

    def _ready(self, df: DataFrame) -> DataFrame:
        fill = {c: -1e9 for c in numeric_columns(df, [self.target, *self.but])}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        """``df`` with the predicted value."""
        keep = df.columns
        rows = df.withColumns({f"_keep_{c}": F.col(c) for c in keep})
        out = self.model.transform(self._ready(rows))
        made = F.col("prediction") if self.labels is None else F.element_at(F.array(*map(F.lit, self.labels)), F.col("prediction").cast("int") + 1)
        return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], made.alias(column))

    def impute(self, df: DataFrame) -> DataFrame:
        done = self.predict(df, "_made")
        return done.withColumn(self.target, F.coalesce(self.target, F.col("_made").cast(df.schema[self.target].dataType))).drop("_made")


def make_robust_mixte_hgb(df: DataFrame, columns: Sequence[str], avoid_new: bool = False, **params) -> DataFrame:
    """Fills each column by boosted trees on the others; ``avoid_new`` snaps numbers to values seen."""
    numbers = [c for c in columns if is_numeric(df, c)]
    out = reduce(lambda d, c: MixteHGBM(**params).fit(d, c).impute(d), columns, df)
    return BinTransformer(numbers).fit(df).transform(out) if avoid_new and numbers else out
