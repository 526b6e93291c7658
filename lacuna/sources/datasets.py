"""Named datasets from local copies, synthetic series, resampling, features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownDataset
from ..functions import rand
from ..operators.holes import add_holes
from .tsf import read_tsf, widen


def read_folder(spark: SparkSession, path: str, ext: str = "csv") -> DataFrame:
    """All files of a folder tree: csv (with header), parquet, json or orc by their reader, tsf by ours."""
    if ext == "tsf":
        return read_tsf(spark, path)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ext}")
    return reader.csv(path, header=True, inferSchema=True) if ext == "csv" else reader.format(ext).load(path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True, **options).csv(path)


def artificial(spark: SparkSession, n: int, periods: Sequence[float], amp_anomalies: float, ratio_anomalies: float, amp_noise: float, seed: int = 0) -> DataFrame:
    """(i, signal, anomaly, noise, value): one plus sines, signed exponential anomalies at keyed places, Gaussian noise."""
    i = F.col("i")
    signal = F.lit(1.0)
    for p in periods:
        signal = signal + F.sin(F.lit(2 * math.pi / p) * i)
    u = F.greatest(rand.uniform([i], seed, 1), F.lit(2.0**-53))
    sign = F.when(rand.uniform([i], seed, 2) < 0.5, -1).otherwise(1)
    anomaly = F.when(rand.uniform([i], seed, 0) < ratio_anomalies, -F.log(u) * amp_anomalies * sign).otherwise(0.0)
    rows = spark.range(n).select(F.col("id").alias("i"))
    return rows.select("i", signal.alias("signal"), anomaly.alias("anomaly"), (rand.normal([i], seed, 2) * amp_noise).alias("noise")).withColumn("value", F.col("signal") + F.col("anomaly") + F.col("noise"))


def daily(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), parts: Sequence[str] = ("year", "month", "day", "hour")) -> DataFrame:
    """Means by day of an hourly table whose time is in number columns."""
    at = F.make_timestamp_ntz(*[F.col(p) for p in parts], F.lit(0), F.lit(0))
    return df.withColumn("date", F.date_trunc("day", at).cast("timestamp_ntz")).groupBy(*by, "date").agg(*[F.avg(c).alias(c) for c in columns])


def top_groups(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """Rows of the ``k`` groups with the largest mean value; ties by name."""
    best = df.groupBy(group).agg(F.avg(value).alias("_m")).orderBy(F.desc("_m"), group).limit(k)
    return df.join(F.broadcast(best.select(group)), group, "left_semi")  # k rows


def beijing(df: DataFrame, columns: Sequence[str] = ("pm2.5",)) -> DataFrame:
    return daily(df.withColumn("station", F.coalesce("station", F.lit("Beijing")) if "station" in df.columns else F.lit("Beijing")), [f"`{c}`" if "." in c else c for c in columns], ["station"]).withColumnsRenamed({f"`{c}`": c for c in columns})


def titanic(df: DataFrame) -> DataFrame:
    return df.select("Survived", "Sex", F.expr("try_cast(Age as double)").alias("Age"), "SibSp", "Parch", F.expr("try_cast(Fare as double)").alias("Fare"), "Embarked", "Pclass")


_TABLES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "Beijing": ("csv", beijing), "Beijing_online": ("csv", beijing), "Titanic": ("csv", titanic), "Superconductor": ("csv", lambda d: d), "Superconductor_online": ("csv", lambda d: d),
    "conductor": ("csv", lambda d: d), "SNCF": ("parquet", lambda d: d), "Monach_weather": ("tsf", widen), "Monach_electricity_australia": ("tsf", widen),
}


def get_data(spark: SparkSession, name: str, path: str | None = None, n_groups_max: int | None = None) -> DataFrame:
    """A named dataset from a local copy at ``path``; Artificial needs none."""
    if name == "Artificial":
        return artificial(spark, 1000, (100, 20), 0.5, 0.05, 0.1)
    if name not in _TABLES:
        raise UnknownDataset(f"no dataset {name}; known are Artificial, {', '.join(_TABLES)}")
    if path is None:
        raise UnknownDataset(f"{name} is read from a local copy: give its path")
    ext, shape = _TABLES[name]
    out = shape(read_folder(spark, path, ext))
    return top_groups(out, "station", "val_in", n_groups_max) if name == "SNCF" and n_groups_max else out


def get_data_corrupted(spark: SparkSession, name: str, columns: Sequence[str], order_by: Sequence[str], groups: Sequence[str] = (), path: str | None = None, mean_size: float = 90, ratio_masked: float = 0.2, seed: int = 0) -> DataFrame:
    return add_holes(get_data(spark, name, path), ratio_masked, mean_size, columns, order_by, groups, seed)


def add_station_features(df: DataFrame, group: str) -> DataFrame:
    """A 0/1 column ``<group>=<value>`` for each value of the group column."""
    values = sorted(r[0] for r in df.select(group).distinct().collect() if r[0] is not None)
    return df.withColumns({f"{group}={v}": F.coalesce((F.col(group) == v).cast("double"), F.lit(0.0)) for v in values})


def year_angle(time: Column) -> Column:
    """The angle of the day in its year, of 365 or 366 days."""
    y = F.year(time)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.dayofyear(time) * F.lit(2 * math.pi) / F.when(leap, 366).otherwise(365)


def add_datetime_features(df: DataFrame, column: str) -> DataFrame:
    angle = year_angle(F.col(column))
    return df.withColumns({"time_cos": F.cos(angle), "time_sin": F.sin(angle)})
