"""Registered queries against their SQL at the smallest scale.

A cross-section runs by default; ORACLE=all runs every query.
"""

import os

import pytest

import __spark_entry__ as spark_entry
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = """
flag_scores win_interpolate win_sliding_grouped scale_robust agg_roc_auc agg_point_adjust agg_threshold_sweep
agg_type_metrics score_ecdf align_labels_any interpret_nodes lagged_spearman assign_groups set_check_partition
graph_gcn_smooth agg_acceptance win_running_best inject_time_warp inject_transplant src_intervals src_plant_csv_lenient
stream_segments
""".split()
NAMES = list(spark_entry.queries()) if os.environ.get("ORACLE") == "all" else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name)
    assert ok, note


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["series_id", "w", "t_end", "score", "threshold"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
