"""Nearest neighbours by pruning against all pairs in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import knn
from lacuna.storage import Scratch


def brute(x, key, k, uniform=False):
    out = x.copy()
    d = x.shape[1]
    for r in np.flatnonzero(np.isnan(x).any(axis=1)):
        shared = ~np.isnan(x) & ~np.isnan(x[r])
        n = shared.sum(axis=1)
        total = np.where(shared, (x - x[r]) ** 2, 0).sum(axis=1)
        dist = np.sqrt(d / np.maximum(n, 1) * total)
        for c in np.flatnonzero(np.isnan(x[r])):
            ok = np.flatnonzero((n > 0) & ~np.isnan(x[:, c]))
            near = ok[np.lexsort((key[ok], dist[ok]))][:k]
            if not len(near):
                out[r, c] = np.nanmean(x[:, c])
            elif uniform:
                out[r, c] = x[near, c].mean()
            else:
                w = (dist[near] == 0).astype(float) if (dist[near] == 0).any() else 1 / dist[near]
                out[r, c] = (w * x[near, c]).sum() / w.sum()
    return out


def table(spark, x, key, g=None):
    pdf = pd.DataFrame({"id": key, "g": g if g is not None else "a"} | {f"c{i}": x[:, i] for i in range(x.shape[1])})
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def clusters(rng, n, d, holes):
    x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 50 + rng.normal(size=(n, d))
    x[rng.random((n, d)) < holes] = np.nan
    return x, rng.permutation(n)


def filled(df, columns, **kw):
    return knn.ImputerKNN(key=["id"], columns=columns, **kw).fit_transform(df).toPandas().set_index("id")


@pytest.mark.parametrize("d,holes,uniform", [(1, 0.1, False), (3, 0.05, False), (6, 0.4, True)])
def test_equals_all_pairs(spark, monkeypatch, d, holes, uniform):
    monkeypatch.setattr(knn, "CELL", 8)
    monkeypatch.setattr(knn, "FAN", 4)  # several levels
    x, key = clusters(np.random.default_rng(d), 500, d, holes)
    x[:60, :] = x[0]  # equal rows, more than the donors that are asked for
    x[60:65, :] = np.nan
    want = brute(x, key, 4, uniform)
    columns = [f"c{i}" for i in range(d)]
    got = filled(table(spark, x, key), columns, n_neighbors=4, most_pairs=0, weights="uniform" if uniform else "distance")
    assert np.allclose(got.loc[key, columns], want)


@pytest.mark.parametrize("most_pairs", [0, knn.PAIRS])
def test_groups_hot_and_null(spark, monkeypatch, most_pairs):
    monkeypatch.setattr(knn, "CELL", 8)
    rng = np.random.default_rng(7)
    x, key = clusters(rng, 400, 2, 0.1)
    g = np.where(rng.random(400) < 0.7, "hot", np.where(rng.random(400) < 0.5, "b", None))
    got = filled(table(spark, x, key, g), ["c0", "c1"], groups=["g"], most_pairs=most_pairs)
    for one in ("hot", "b", None):
        mine = np.array([v is one or v == one for v in g])
        assert np.allclose(got.loc[key[mine], ["c0", "c1"]], brute(x[mine], key[mine], 5))


def test_pairs_stay_below_all(spark):
    x, key = clusters(np.random.default_rng(3), 8000, 3, 0.0)
    x[:800, 0] = np.nan
    rows = table(spark, x, key).select(F.lit(0).alias("g"), F.struct("id").alias("key"), *[F.col(f"c{i}").alias(f"x{i}") for i in range(3)])
    _, pairs = knn.candidates(rows, ["x0", "x1", "x2"], [0], 5, Scratch(spark))
    assert pairs.count() < 800 * 8000 / 10


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.0, 5.0)], "id long, c0 double, c1 double")
    model = knn.ImputerKNN(key=["id"], columns=["c0", "c1"], most_pairs=0).fit(df)
    assert model.transform(df.limit(0)).count() == 0
    assert model.transform(df).where("id = 1").first()["c1"] == 5.0
