"""Distance correlation in blocks and tiles against the matrices themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import distances, metrics
from lacuna.operators.metrics import MASK, SUFFIX
from lacuna.storage import Scratch


def test_dominated():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 61, 200):
        u, y, x = rng.integers(0, 9, n), rng.integers(0, 12, n).astype(float), rng.normal(size=n)
        brute = sum((x[i] - x[j]) * (y[i] - y[j]) for i in range(n) for j in range(n) if u[j] < u[i] and y[j] < y[i])
        assert distances.dominated(u, y, x, y) == pytest.approx(brute, abs=1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    tied = np.where(rng.random(2000) < 0.35, 7.0, np.round(x, 1))  # a third of all rows in one value
    pdf = pd.DataFrame({"x": x + 1e6, "y": x**2 + rng.normal(size=2000), "t": tied, "z": rng.exponential(size=2000) * 1e3, "one": 1.0})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("a, b", [("x", "y"), ("t", "x"), ("x", "t"), ("t", "t"), ("x", "z"), ("x", "one")])
def test_line_equals_brute_force(sample, a, b):
    pdf, df = sample
    expected = metrics.distance_anticorrelation(pdf[[a]].to_numpy(), pdf[[b]].to_numpy())
    for rows in (150, 10_000):
        assert distances.distance_anticorrelation(df, [a], [b], rows) == pytest.approx(expected, abs=1e-6)


def test_tiles_equal_brute_force(sample):
    pdf, df = sample
    expected = metrics.distance_anticorrelation(pdf[["x", "t"]].to_numpy(), pdf[["y", "z"]].to_numpy())
    assert distances.distance_anticorrelation(df, ["x", "t"], ["y", "z"], 300) == pytest.approx(expected, abs=1e-6)


def test_odd(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, None), (3.0, 5.0, None), (None, 1.0, None)], "a double, b double, c double")
    got = distances.distance_anticorrelation(df, ["a"], ["b"])
    assert got == pytest.approx(metrics.distance_anticorrelation(np.array([[1.0], [2], [3]]), np.array([[2.0], [1], [5]])))
    assert np.isnan(distances.distance_anticorrelation(df, ["a"], ["c"]))
    with pytest.raises(ValueError):
        distances.distance_anticorrelation(df, ["a"], ["b", "c"])


def test_large_patterns_as_small_ones(sample):
    pdf, df = sample
    scored = df.select(F.col("x"), F.col("y").alias("x" + SUFFIX), F.col("t"), F.col("z").alias("t" + SUFFIX), (F.col("z") > 300).alias(MASK + "x"), (F.col("x") > 1e6).alias(MASK + "t"))
    assert metrics.dist_corr_pattern(scored, ["x", "t"], task_rows=100) == pytest.approx(metrics.dist_corr_pattern(scored, ["x", "t"]), abs=1e-6)


def test_tiles_do_not_multiply_with_the_rows(spark, monkeypatch):
    """Beyond the most blocks, blocks grow and are walked through in pieces: the same value, and few tiles."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    rows = spark.createDataFrame([tuple(map(float, (*p, *q))) for p, q in zip(x, x**2 + rng.normal(size=(600, 2)))], "a double, b double, c double, d double")
    before = distances.distance_anticorrelation(rows, ["a", "b"], ["c", "d"], 600)
    monkeypatch.setattr(distances, "MOST_TILES", 4)
    monkeypatch.setattr(distances, "HELD_ROWS", 64)
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t", **k: saved.append((name, save(self, df, name, **k))) or saved[-1][1])
    assert distances.distance_anticorrelation(rows, ["a", "b"], ["c", "d"], 5) == pytest.approx(before, abs=1e-12)
    assert dict(saved)["blocks"].count() == 4
