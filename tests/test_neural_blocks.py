"""Networks of groups in several blocks: those that one task trains, or as good; no group meets in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import neural

KW = {"order_by": ["i"], "key": ["i"], "columns": ["x", "y"]}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "b" if i % 10 == 3 else "a", i / 200 + float(rng.normal()) / 10) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, x double").withColumn("y", F.when(F.col("i") % 7 != 2, 3 * F.col("x") + 1))
    return df.withColumn("x", F.when(F.col("i") % 11 != 5, F.col("x"))).withColumn("_s", -F.col("i")).cache()


def filled(imputer, df):
    return imputer.fit_transform(df).toPandas().sort_values("i", ignore_index=True)


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("make", [lambda **k: neural.ImputerRegressorMLP(epochs=6, **k), lambda **k: neural.ImputerAutoencoder(max_iterations=2, epochs=3, lamb=0.0, **k)])
def test_blocks_train_what_one_task_trains(table, make, groups):
    # Group b has 60 rows, fewer than a block, and goes its own way.
    whole, blocks = filled(make(groups=groups, **KW), table), filled(make(groups=groups, block_rows=100, **KW), table)
    assert np.allclose(whole[["x", "y"]], blocks[["x", "y"]], atol=1e-8) and len(blocks) == 600


@pytest.mark.parametrize("model", ["TabDDPM", "TsDDPM"])
def test_diffusion_in_blocks(table, model, monkeypatch):
    seen = []
    monkeypatch.setattr(neural, "per_group", lambda self, asked, run: lambda d: seen.append(d) or d)
    got = filled(neural.ImputerDiffusion(model=model, epochs=3, num_noise_steps=5, num_sampling=2, batch_size=20, block_rows=100, **KW), table)
    old = table.toPandas().sort_values("i", ignore_index=True)
    assert not seen and not got[["x", "y"]].isna().any().any() and list(got.columns) == list(old.columns)
    for c in "xy":
        hole = old[c].isna()
        assert (got[c][~hole] == old[c][~hole]).all() and got[c][hole].between(old[c].min(), old[c].max()).all()


def test_windows_over_a_border():
    z = np.arange(40.0).reshape(20, 2)
    imputer = neural.ImputerDiffusion(model="TsDDPM", freq_rows=4, **KW)
    whole = imputer._windows(z, 0)[0]
    assert (imputer._windows(z[7:], 3)[0] == whole[10:]).all()
