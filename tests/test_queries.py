"""Registered queries against their SQL on the smallest given tables.

By default one query per area; FAULTSCOPE_FULL=1 runs all of them.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = """panel_day panel_long split_at_injection_day features_workload_day features_statistical_day cross_service_sync_day
    spectral_features_day periodicity_long feature_table recording_reader parse_case_name canonical_pivot split_guard_and_missing_time
    split_case_table weighted_buckets metric_bundle confusion_matrix rank_metrics reliability_table threshold_sweep mcnemar welch_t_test
    bootstrap_rows result_upsert merge_systems series_positions sliding_windows resample_linear ewma change_points_day
    stratified_split exact_quantiles normalised_tensor nearest_centroid side_tables_mixed_headers recording_tree_multi side_files_stored
    features_with_gaps metric_bundle_with_ranks nested_json_upsert""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("FAULTSCOPE_FULL") else CORE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    diffs, rows = compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name], duck)
    assert diffs == []
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 47
    assert df.count() > 0
