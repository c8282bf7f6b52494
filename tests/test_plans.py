"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from reelspark.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
ARROW_ALLOWED = {"keyword_matches_preview", "color_coverage_packed"}
BUILT = {n: q for n, q in QUERIES.items() if not n.startswith("stream_")}


@pytest.fixture(scope="module")
def plans(spark):
    return {n: q(spark, SF)._jdf.queryExecution().executedPlan().toString() for n, q in BUILT.items()}


def test_no_pairwise_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_python_only_where_needed(plans):
    for name, plan in plans.items():
        used = any(p in plan for p in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython", "FlatMapGroupsInPandas"))
        assert used == (name in ARROW_ALLOWED), name


def test_windows_are_never_unpartitioned(plans):
    """No window gathers everything into one task."""
    for name, plan in plans.items():
        assert "SinglePartition" not in plan or all(
            "Aggregate" in line or "Exchange SinglePartition" in line or "Limit" in line or "TakeOrdered" in line
            for line in plan.splitlines()
            if "SinglePartition" in line
        ), name
        for line in plan.splitlines():
            if line.strip(" :+-*(0123456789)").startswith("Window ["):
                assert "windowspecdefinition(" in line and "windowspecdefinition(specifiedwindowframe" not in line, name


def test_scans_are_pruned(plans):
    plan = plans["clip_merge_by_video"]
    scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert scans and all("props" not in s.split("ReadSchema")[-1] for s in scans)
    assert len(scans) == 1, "one pass over the events"


def test_merge_buckets_every_window(plans):
    assert "bucket" in plans["kill_type_totals"]


def test_filters_reach_the_scan(spark):
    from reelspark.plans.inputs import table

    plan = table(spark, SF, "events").filter(F.col("event_type") == "click").select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan


def test_most_queries_have_sql():
    without = set(QUERIES) - set(ORACLE)
    assert without == {"keyword_matches_preview"}
