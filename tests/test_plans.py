"""Physical plans: what is shuffled, and by what."""

import re

import pytest

from tsengine.plans.catalog import QUERIES

ORDERED = [
    "evaluate_panel", "windows_xy", "windows_marks", "prepare_split", "point_adjust", "early_stop_epoch", "trend_season",
    "forecast_sigma", "forecast_recursive", "forecast_direct_one_lag", "scale_transform", "row_index", "moving_frame",
]


def plan(spark, name, folder):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ORDERED)
def test_no_series_is_gathered_in_one_task(spark, tiny, name):
    text = plan(spark, name, tiny)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if re.search(r"\bWindow(Exec)?\b", line) and "row_number" in line:
            assert "_block" in line, line  # rows are numbered inside blocks
        if "collect_list" in line and "Aggregate" in line:
            assert "chunk" in line or "step" in line, line  # arrays are bounded
    # one partition is only used for a final row of an ungrouped aggregate
    single = [i for i, line in enumerate(text.splitlines()) if "SinglePartition" in line]
    for i in single:
        assert "Aggregate" in text.splitlines()[i + 1], text.splitlines()[i + 1]


def test_windows_are_cut_without_another_shuffle(spark, tiny):
    """Below the metrics: one shuffle of the rows; the statistics join and the arrays share it."""
    text = plan(spark, "evaluate_panel", tiny)
    left = text[: text.index("ShuffledHashJoin")]
    assert left.count("Exchange") == 1  # the final aggregate
    assert "ObjectHashAggregate" in left


def test_panel_scan_reads_three_columns(spark, tiny):
    text = plan(spark, "evaluate_panel", tiny)
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert all("props" not in s and "event_type" not in s for s in schemas)


def test_one_long_series_is_windowed_by_block(spark, tiny):
    text = plan(spark, "windows_single_series", tiny)
    assert "SinglePartition" not in text
