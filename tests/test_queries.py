"""Registered queries against their SQL on the smallest tables.

A spread of queries by default; TEST_ALL_QUERIES=1 runs every one that has SQL.
"""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SPREAD = (
    "win1_lags", "win9_rolling_zscore", "win13_rolling_trend", "win15_exponential_mean", "bundle_extended_features", "long_series_windows",
    "long_series_expanding", "cln3_extract_number", "cln5_fill_long_series", "cln6_fill_median", "cln12_repeat_last", "joi5_mention_join",
    "agg3_category_stats", "agg8_describe", "agg13_box_by_month", "agg22_normal_plot", "arr4_z_norm", "dst3_warping_to_previous",
    "spc1_top_frequencies", "spc3_wavelet_energies", "reg1_change_points", "spl3_holdout_rule", "unc2_finite_sample_conformal",
    "unc10_bootstrap_percentiles", "drf3_drift_score", "mon2_alerts", "aug4_random_copies", "mlp7_cv_metrics", "mlp18_ar1_forecast",
    "src1_load_series", "snk5_key_value_metrics", "stream_daily_metrics", "stream_drift_state", "x4_mutual_information", "x5_sample_crps",
    "x6_wasserstein_drift", "unc6_two_linear_models", "unc10_given_function", "mlp8_dated_folds", "mlp10_full_stack", "mlp20_routed_forecast",
    "mlp25_pipeline_of_components", "mlp26_one_job_per_model", "reg1_long_series", "spc6_known_waves",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TEST_ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.10g}"
        return "null" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark, tables):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, duck, name):
    df = entry.queries()[name](spark, tables)
    got = df.collect()
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert cells(got, df.columns) == cells(cur.fetchall(), names)


def _without_sql():
    # those of the corpus have tests of their own
    return sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", _without_sql())
def test_query_without_sql_runs(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0
