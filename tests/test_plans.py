"""Physical-plan properties of the registered queries (scale guards)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
from odspark.plans import registry

NAMES = sorted(n for n in registry.queries() if not n.startswith("model_"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_udf_no_cross_join(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_congestion_single_scan_and_pushdown(spark):
    plan = plan_of(E.queries()["congestion_by_route"](spark, SF))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    od_scans = [s for s in scans if "board_ars#" in s and "alight_ars#" in s]
    assert len(od_scans) == 1                       # one scan of the OD fact (explode, not UNION)
    # only the needed columns are read
    assert "board_code" not in od_scans[0] and "route_id" not in od_scans[0]
    # the bounding box reaches the location scan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(lat,37\.0\)", plan)
    # raw rows are shuffled once (the stop aggregate); the windows share one (date, route) exchange
    assert plan.count("Exchange hashpartitioning(service_date") == 2


def test_dedup_pre_aggregates(spark):
    plan = plan_of(E.queries()["dedup_sum"](spark, SF))
    assert "partial_sum" in plan and "HashAggregate" in plan


def _od_scans(plan: str) -> int:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    return sum(1 for s in scans if "board_ars#" in s and "alight_ars#" in s)


def test_map_markers_scan_and_no_window_per_date(spark):
    # the congestion rows are staged once; what is left reads the OD fact for the payload only
    plan = plan_of(E.queries()["map_markers"](spark, SF))
    assert _od_scans(plan) == 1
    for name in ("map_markers", "map_segments", "network_congestion", "stop_density"):
        plan = plan_of(E.queries()[name](spark, SF))
        assert not re.search(r"windowspecdefinition\(service_date#\d+, (?!route_name)", plan), name


def test_null_fill_splits_on_pushed_null_filter(spark):
    plan = plan_of(E.queries()["fill_null_codes_board"](spark, SF))
    assert "IsNull(board_code)" in plan and "IsNotNull(board_code)" in plan
    assert "Union" in plan


def test_enrichment_plan_stays_small(spark):
    plan = plan_of(E.queries()["enrich_od"](spark, SF))
    assert plan.count("Exchange") <= 12
