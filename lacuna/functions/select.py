"""Exact order statistics of many columns by counting, without sorting a column or gathering it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits below those that a pass settles: 22, then 21 and 21 of the 64 of a double.
SHIFTS = (42, 21, 0)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order; -0 as 0."""
    bits = (np.asarray(x, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.uint64)
    return np.where(k >> np.uint64(63) == 1, k & np.uint64((1 << 63) - 1), ~k).view(float)


def order_statistics(rows: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[float]]:
    """By column the known values at 0-based ``ranks`` among its known values.

    Three passes settle the bits of all asked values from the top; a pass counts
    values by their next bits below the prefixes still open, at most 2^22 counts a
    prefix, and only the asked ranks come to the driver.  Ranks must lie below the
    column's count of known values.
    """
    names = [c for c in ranks if ranks[c]]
    if not names:
        return {c: [] for c in ranks}
    spark = rows.sparkSession
    asked = pd.DataFrame([(names.index(c), k, 0, int(r)) for c in names for k, r in enumerate(ranks[c])], columns=["c", "k", "prefix", "r"])
    for step, shift in enumerate(SHIFTS):
        wanted = {c: np.unique(part["prefix"].to_numpy(np.uint64)) for c, part in asked.groupby("c")}

        def count(batches, shift=shift, first=not step, wanted=wanted):
            for pdf in batches:
                for c, open_ in wanted.items():
                    v = pdf[names[c]].to_numpy(float, na_value=np.nan)
                    at = ordered_bits(v[~np.isnan(v)]) >> np.uint64(shift)
                    if not first:
                        at = at[np.isin(at >> np.uint64(21), open_)]
                    value, n = np.unique(at, return_counts=True)
                    # The top bit of a full key does not fit a signed long: halves travel apart.
                    yield pd.DataFrame({"c": c, "prefix": (value >> np.uint64(21)).astype(np.int64) if not first else 0, "at": (value & np.uint64((1 << (22 if first else 21)) - 1)).astype(np.int64), "n": n})

        counts = rows.select(*names).mapInPandas(count, "c int, prefix long, at long, n long").groupBy("c", "prefix", "at").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "prefix").orderBy("at")))
        met = upto.join(F.broadcast(spark.createDataFrame(asked, "c int, k int, prefix long, r long")), ["c", "prefix"]).where("r < upto AND r >= upto - n")
        got = met.select("c", "k", "prefix", "at", (F.col("r") - F.col("upto") + F.col("n")).alias("r")).toPandas()
        got["prefix"] = [(int(p) << 21) + int(a) if step else int(a) for p, a in zip(got["prefix"], got["at"])]
        if step == len(SHIFTS) - 1:
            values = {(c, k): v for c, k, v in zip(got["c"], got["k"], from_ordered_bits(np.array([int(p) for p in got["prefix"]], np.uint64)))}
            return {c: [float(values[names.index(c), k]) for k in range(len(ranks[c]))] if ranks[c] else [] for c in ranks}
        asked = got[["c", "k", "prefix", "r"]]
    raise AssertionError
