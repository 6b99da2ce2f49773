"""The registry, and a sample of its queries against DuckDB."""

import duckdb
import pytest

import check
from donorflow.catalog import load

SAMPLE = [
    "whole_series_features", "exclusion_audit", "calendar_range_count", "asof_previous_full_blood", "last_try_of_day",
    "data_counts_by_age", "variable_summary", "threshold_sweep", "auroc_ci", "aupr", "optimal_f1_cut", "cost_by_threshold",
    "stratified_sample", "dlmm_design", "donor_effect_posterior", "posterior_effects", "interval_extension", "frame_diff",
]


def test_names():
    queries, sql = load()
    assert len(queries) == 203 and set(sql) <= set(queries)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, folder, name):
    queries, sql = load()
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = queries[name](spark, folder)
    found = con.execute(sql[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, found.fetchall())
