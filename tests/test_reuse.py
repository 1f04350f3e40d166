"""Reuse by input fingerprint, runtime partition pruning, sections without windows."""

import os

import pytest
from conftest import od_row, rows_of

from odspark.operators import congestion as cg
from odspark.plans import maps
from odspark.session import drop_path
from odspark.sources import io

LOC = "stop_no string, stop_name string, lat double, lon double"


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("service_date=")}


def test_only_changed_dates_are_computed_again(spark, make_od, tmpdir_path):
    od, cache = f"{tmpdir_path}/od", f"{tmpdir_path}/cache"
    loc = spark.createDataFrame([("'01001", "'S1001", 37.5, 127.0)], LOC)
    days = ["20231017", "20241019", "20251014"]
    io.write_od(make_od([od_row(date=d, riders=50 + i) for i, d in enumerate(days)]), od)
    assert maps.refresh_congestion(spark, od, loc, cache) == days
    before = files(cache)
    assert maps.refresh_congestion(spark, od, loc, cache) == [] and files(cache) == before

    io.write_od(make_od([od_row(date=days[1], riders=90), od_row(date=days[1], route="R2", riders=7)]), od)
    assert maps.refresh_congestion(spark, od, loc, cache) == [days[1]]
    after = files(cache)
    assert [d for d in before if before[d] != after[d]] == [f"service_date={days[1]}"]
    assert rows_of(maps.read_congestion(spark, cache), cg.ROUTE_KEY + cg.SECTION_COLS) == rows_of(
        cg.congestion(io.read_od(spark, od), loc), cg.ROUTE_KEY + cg.SECTION_COLS)

    # a side table that changed makes every date stale; a date that left is removed
    moved = spark.createDataFrame([("'01001", "'S1001", 37.6, 127.0)], LOC)
    drop_path(spark, f"{od}/service_date={days[0]}")
    assert sorted(maps.refresh_congestion(spark, od, moved, cache)) == days
    assert {r.service_date for r in maps.read_congestion(spark, cache).collect()} == set(days[1:])
    assert maps.refresh_congestion(spark, od, moved, cache) == []


def test_killed_refresh_is_repeated(spark, make_od, tmpdir_path):
    od, out = f"{tmpdir_path}/od", f"{tmpdir_path}/out"
    io.write_od(make_od([od_row(date="20231017", riders=1)]), od)
    copy = lambda dates: io.read_od(spark, od, dates)
    io.refresh_dates(spark, od, out, copy)

    def dies(dates):
        raise RuntimeError("lost")

    io.write_od(make_od([od_row(date="20231017", riders=2)]), od)
    with pytest.raises(RuntimeError):
        io.refresh_dates(spark, od, out, dies)
    assert io.refresh_dates(spark, od, out, copy) == ["20231017"]
    assert [r.riders for r in io.read_od(spark, out).collect()] == [2]
    # a changed date without rows now loses the old ones
    io.write_od(make_od([od_row(date="20231017", riders=3)]), od)
    io.refresh_dates(spark, od, out, lambda dates: copy(dates).where("riders > 3"))
    assert io.read_od(spark, out).count() == 0


def test_request_table_prunes_partitions(spark, make_od, tmpdir_path):
    od, req = f"{tmpdir_path}/od", f"{tmpdir_path}/req"
    io.write_od(make_od([od_row(date=d, riders=1) for d in ("20231017", "20241019", "20251014")]), od)
    spark.createDataFrame([("20241019", 1), ("20231017", 0), ("19990101", 1), (None, 1)], "service_date string, wanted int"
                          ).write.parquet(req)
    df = io.read_od(spark, od, spark.read.parquet(req).where("wanted = 1"))
    assert [r.service_date for r in df.collect()] == ["20241019"]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def test_sections_run_no_window_over_requests(spark, make_od):
    cong = cg.congestion(make_od([od_row(bseq=i, bname=f"S{i}", aseq=i + 1, aname=f"S{i + 1}", riders=9) for i in range(1, 9)]))
    req = spark.createDataFrame([("20231017", "R1", "S2", "S4"), ("20231017", "R1", "S2", "S4"), ("20231017", "R1", "S7", None),
                                 ("20231017", "R1", None, "S4"), ("20231017", "R9", "S1", "S2")],
                                "service_date string, route_name string, from_name string, to_name string")
    out = cg.section_congestion(cong, req)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_name" not in "".join(x for x in plan.splitlines() if "Window" in x)
    got = [(r.from_name, r.to_name, r.stop_name) for r in out.collect()]
    assert sorted(set(got), key=str) == sorted(
        [("S2", "S4", f"S{i}") for i in (2, 3, 4)] + [("S7", None, f"S{i}") for i in (7, 8, 9)], key=str)
    # a request made twice is answered twice, as a join does
    assert sum(x[:2] == ("S2", "S4") for x in got) == 2 * sum(x[:2] == ("S7", None) for x in got)
