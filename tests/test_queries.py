"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

WHERE = Path("/root/testdata/sf0.001")
FAST = ["impute_linear", "impute_mean", "impute_mode", "impute_locf_global", "impute_knn", "impute_mice_one_sweep", "hole_transition_probs", "metric_ks", "metric_energy", "little_d2_monotone", "bins_snap", "daily_resample",
        "impute_time_linear", "impute_em_mle", "impute_mice_full", "impute_spline", "impute_quadratic", "tsf_source", "impute_rpca_pcp", "impute_rpca_noisy", "impute_softimpute", "holes_grouped", "metric_anova_f", "metric_chi2_stat", "nan_mean_cov", "fold_signal", "acf", "pklm_decision", "metric_distance_correlation"]


@pytest.fixture(scope="module")
def duck():
    if not WHERE.exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in WHERE.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    mine, theirs = entry.queries()[name](spark, str(WHERE)).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if WHERE.exists():
        assert entry.entry(spark).count() > 0
