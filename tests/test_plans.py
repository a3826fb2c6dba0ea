"""Plans hold no Python per row, no nested loops, and no sort of a whole table in one task."""

import re

import pytest
from pyspark.sql import functions as F

import bindings
from airgrid.operators import joins as J
from airgrid.operators import windows as W
from bindings.registry import Tables

FOLDER = "/root/testdata/sf0.001"
NO_PLAN = {q for q in bindings.QUERIES if q.startswith(("ml_", "src_quarantined", "src_file", "job_chained"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - NO_PLAN))
def test_plan_is_native(spark, name):
    text = plan(bindings.QUERIES[name](spark, FOLDER))
    for unwanted in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text
    # a window without keys only runs over counted bands
    for window in re.findall(r"(Window .*)\n.*\n.*SinglePartition", text):
        assert "_band" in window


def test_rank_limit_reaches_the_input_side(spark):
    t = Tables(spark, FOLDER)
    text = plan(W.nearest_rank(t.aod_cells, ["grid_id"], "lon", 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(bindings.QUERIES["src_parquet_scan"](spark, FOLDER))
    assert "GreaterThan(l_quantity,25.0)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text


def test_interval_join_hashes_on_the_day(spark):
    t = Tables(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(J.interval_join(t.labels_grid, t.geos, ["grid_id"], "datetime", "time", back=1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "_day" in text


def test_random_split_needs_no_shuffle(spark):
    assert "Exchange" not in plan(bindings.QUERIES["split_random_days"](spark, FOLDER))


def test_one_shuffle_for_all_band_statistics(spark):
    text = plan(bindings.QUERIES["agg_band_min_max_median"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning") == 1
