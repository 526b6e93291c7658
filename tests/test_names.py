"""Columns of the user with the names of inner columns come back as they were, with every imputer that works by columns."""

import pytest

from lacuna.operators import chained, em, knn, lowrank, regress, simple  # noqa: F401

N = None
NAMES = ["_rn", "_b", "_off", "_n", "_p", "_x", "_one", "_f_x", "_i_x", "_p_x", "_q_x", "_m", "_g_g", "_mode", "_range", "_rows", "_order"]
KW = {"groups": ["g"], "order_by": ["i"], "key": ["i"], "columns": ["x", "y"]}


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i, "ab"[i % 2], float(i * 7 % 11), N if i % 5 == 3 else float(i * 3 % 13)) for i in range(30)]
    return spark.createDataFrame(rows, "i int, g string, x double, y double").cache()


@pytest.mark.parametrize(
    "make",
    [simple.ImputerSimple, simple.ImputerLOCF, simple.ImputerNOCB, simple.ImputerInterpolation, lambda **k: simple.ImputerInterpolation(n_blocks=3, **k), lambda **k: simple.ImputerResiduals(period=3, **k),
     simple.ImputerShuffle, knn.ImputerKNN, lambda **k: regress.ImputerMICE(max_iter=1, estimator="ols", **k), regress.ImputerRegressor, em.ImputerEM, lambda **k: simple.ImputerInterpolation(method="cubic", **k)],
)
def test_user_columns_survive(spark, plain, make):
    crowded = plain.selectExpr("*", *[f"-5.0 - i AS {c}" for c in NAMES])
    before = {r["i"]: r for r in make(**KW).fit_transform(plain).collect()}
    out = make(**KW).fit_transform(crowded)
    assert out.columns == crowded.columns
    got = {r["i"]: r for r in out.collect()}
    assert got.keys() == before.keys()
    for i, r in got.items():
        assert (r["x"], r["y"]) == pytest.approx((before[i]["x"], before[i]["y"])) and all(float(r[c]) == -5.0 - i for c in NAMES)
