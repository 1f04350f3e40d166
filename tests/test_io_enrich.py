"""CSV sources/sinks, the OD store, staged publish, and enrichment rules."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import od_row
from odspark.operators import enrich as en
from odspark.sources import io
from odspark.sources.code_lookup import parse_code_responses


def test_raw_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    with open(p, "wb") as f:
        f.write("﻿ 노선명 ,승차_정류장ARS,하차_정류장명\r\n".encode("utf-8"))
        f.write('"100",07511,"A, B"\r\n'.encode("utf-8"))
        f.write("200,NULL,C\r\n".encode("utf-8"))
    df = io.read_raw_csv(spark, p, null_value="NULL")
    assert df.columns == ["노선명", "승차_정류장ARS", "하차_정류장명"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("100", "07511", "A, B"), ("200", None, "C")]


def test_pipe_csv_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("a,b", "1"), ('say "hi" | x', "2")], "name string, n string")
    out = os.path.join(tmpdir_path, "out")
    io.write_csv(df, out, sep="|")
    back = io.read_raw_csv(spark, out, sep="|")
    assert sorted(tuple(r) for r in back.collect()) == [("a,b", "1"), ('say "hi" | x', "2")]


def test_bad_records_are_kept_apart(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    with open(p, "wb") as f:
        f.write("\ufeffa,b,c\r\n1,2,3\r\n1,2\r\n\r\n1,2,3,4\r\n\"x,y\",NULL,3\r\n\"open,2,3\r\n,,\r\n".encode("utf-8"))
    rows, bad = io.read_checked_csv(spark, p, ["a", "b", "c"])
    assert rows.columns == ["a", "b", "c"] and bad.columns == [io.BAD_LINE]
    assert sorted((r.a or "", r.b, r.c) for r in rows.collect()) == [("", None, None), ("1", "2", "3"), ("x,y", None, "3")]
    assert sorted(r.bad_line for r in bad.collect()) == ['"open,2,3', "1,2", "1,2,3,4"]
    assert bad.count() == 3 and rows.select("c").where("c = '3'").count() == 2  # pruned columns change nothing


def test_store_and_publish(spark, make_od, tmpdir_path):
    od = make_od([od_row(date="20231017", riders=3), od_row(date="20241019", riders=4)])
    final = os.path.join(tmpdir_path, "final")
    io.write_od(od, final)
    newer = make_od([od_row(date="20241019", riders=9)])
    with pytest.raises(ValueError):
        io.publish(newer, os.path.join(tmpdir_path, "stg1"), final, checks=[io.riders_conserved(1)])
    assert io.read_od(spark, final).agg(F.sum("riders")).first()[0] == 7
    io.publish(newer, os.path.join(tmpdir_path, "stg2"), final, checks=[io.riders_conserved(9)])
    got = {r.service_date: r.riders for r in io.read_od(spark, final).collect()}
    assert got == {"20231017": 3, "20241019": 9}
    assert io.read_od(spark, final, dates=["20231017"]).count() == 1


def test_materialize_reuse(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m")
    assert io.materialize(spark.range(3).toDF("x"), p).count() == 3
    assert io.materialize(spark.range(5).toDF("x"), p).count() == 3                # reused
    assert io.materialize(spark.range(5).toDF("x"), p, refresh=True).count() == 5  # rebuilt


def test_code_lookup(spark):
    resp = spark.createDataFrame([("01001", '[{"sttnId":"101001000"},{"sttnId":"x"}]'),
                                  ("01002", "[]"), ("01003", "oops")], "ars string, body string")
    got = {r.ars: r.code for r in parse_code_responses(resp).collect()}
    assert got == {"01001": "101001000", "01002": None, "01003": None}


def test_cross_fill_order(spark):
    # boarding ARS known only as an alighting ARS elsewhere, and vice versa
    df = spark.createDataFrame([
        ("d", "R", "1", "1", "01001", None, "A", "2", "02002", "C2", "B", "1"),
        ("d", "R", "1", "2", "02002", None, "B", "3", "01001", None, "A", "1"),
        ("d", "R", "1", "3", "03003", "C3", "X", "4", "09009", None, "Z", "1"),
        ("d", "R", "1", "4", "09009", None, "Z", "5", "05005", None, "Q", "1"),
    ], ", ".join(f"{c} string" for c in en.OUT_COLUMNS))
    out = {(r.board_ars, r.alight_ars): (r.board_code, r.alight_code)
           for r in en.fill_codes(df, 3).collect()}
    # stage 3a: alighting 01001 has no donor (boarding 01001 has no code) ; stage 3b:
    # boarding 02002 takes the alighting code C2
    assert out[("02002", "01001")] == ("C2", None)
    # alighting 09009 takes boarding... nothing; boarding 09009 stays NULL
    assert out[("09009", "05005")][0] is None


def test_nightly_job(spark, tmpdir_path):
    from odspark.plans.pipeline import run_nightly
    from odspark.sources.fixtures import Tables
    od = Tables(spark, "/root/testdata/sf0.001").od()
    src = os.path.join(tmpdir_path, "od")
    io.write_od(od, src)
    final = os.path.join(tmpdir_path, "final")
    res = run_nightly(spark, src, final, os.path.join(tmpdir_path, "stg"),
                      os.path.join(tmpdir_path, "anom"), ["20231017", "20251014"])
    out = io.read_od(spark, final)
    assert sorted(r.service_date for r in out.select("service_date").distinct().collect()) == [
        "20231017", "20251014"]
    rin = od.where(F.col("service_date").isin("20231017", "20251014")).agg(F.sum("riders")).first()[0]
    ranom = spark.read.parquet(os.path.join(tmpdir_path, "anom")).agg(F.sum("riders")).first()[0]
    assert out.agg(F.sum("riders")).first()[0] + ranom == rin
    assert res.step_counts.count() == 2


def test_nightly_job_is_idempotent(spark, tmpdir_path):
    from odspark.plans.pipeline import run_nightly
    from odspark.sources.fixtures import Tables
    od = Tables(spark, "/root/testdata/sf0.001").od()
    src = os.path.join(tmpdir_path, "od")
    io.write_od(od, src)
    final, anom = os.path.join(tmpdir_path, "final"), os.path.join(tmpdir_path, "anom")
    for i in range(2):  # a retry of the same date
        run_nightly(spark, src, final, os.path.join(tmpdir_path, f"stg{i}"), anom, ["20241019"])
    rin = od.where(F.col("service_date") == "20241019").agg(F.sum("riders")).first()[0]
    rout = io.read_od(spark, final).agg(F.sum("riders")).first()[0]
    ranom = io.read_od(spark, anom).agg(F.sum("riders")).first()[0]
    assert rout + ranom == rin


def test_nightly_job_in_place(spark, tmpdir_path):
    from odspark.plans.pipeline import run_snapshot
    from odspark.sources.fixtures import Tables
    from odspark.sources.snapshots import Snapshots
    od = Tables(spark, "/root/testdata/sf0.001").od()
    store = Snapshots(spark, os.path.join(tmpdir_path, "store"))
    dates = [r[0] for r in od.select("service_date").distinct().collect()]
    run_snapshot(store, dates, source=od)
    before = sorted(map(tuple, store.read("anomalies").collect()))
    run_snapshot(store, ["20231017"])
    riders = [store.read(t).agg(F.sum("riders")).first()[0] for t in ("input", "od", "anomalies")]
    assert riders[0] == riders[1] + riders[2] == od.agg(F.sum("riders")).first()[0]
    assert before and sorted(map(tuple, store.read("anomalies").collect())) == before
    assert store.read("od").select("service_date").distinct().count() == len(dates) == 3


def test_nightly_cli(spark, tmpdir_path):
    from odspark.plans.pipeline import main
    from odspark.sources.fixtures import Tables
    src = os.path.join(tmpdir_path, "od")
    io.write_od(Tables(spark, "/root/testdata/sf0.001").od(), src)
    rep = os.path.join(tmpdir_path, "report")
    main(["--od", src, "--store", os.path.join(tmpdir_path, "store"),
          "--report", rep, "--date", "20231017", "--date", "20251014"])
    r = spark.read.parquet(rep)
    assert r.count() == 2 and "c5c2" in r.columns and "null_board_seq" in r.columns
    assert all(row.bidirectional_routes == ["R0"] for row in r.collect())   # route R0 has 120 stops


def test_map_build_matches_queries(spark, tmpdir_path):
    import __spark_entry__ as E
    from conftest import rows_of
    from odspark.plans.maps import build_map_layers
    from odspark.sources.fixtures import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    layers = build_map_layers(t.od(), t.loc(), cache_path=os.path.join(tmpdir_path, "cong"))
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    assert rows_of(layers["density"]) == rows_of(q["stop_density"](spark, sf))
    assert rows_of(layers["segments"].withColumn("pos", F.col("pos").cast("int"))) == rows_of(
        q["map_segments"](spark, sf))
    assert layers["legend"].count() == 5


def test_cluster_settings_scale_with_input():
    from odspark.session import cluster_settings
    small = cluster_settings(1 << 30, 16)
    big = cluster_settings(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 32            # two waves of 16 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 20_000           # bounded for the driver
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(big["spark.sql.autoBroadcastJoinThreshold"]) == 64 << 20


def test_to_od_schema_casts_safely(spark):
    from odspark.constants import OD_COLUMNS
    df = spark.createDataFrame([("20251014", "R1", "100001", "x", "01001", "c", "A", "3", "01002", "d",
                                 "B", "7")], ", ".join(f"{c} string" for c in OD_COLUMNS))
    r = io.to_od_schema(df).first()
    assert (r.route_id, r.board_seq, r.alight_seq, r.riders) == (100001, None, 3, 7)


def test_enrich_job_end_to_end(spark, tmpdir_path):
    import __spark_entry__ as E
    from odspark.plans.enrich_job import run
    from odspark.sources.fixtures import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    tgt, ref = os.path.join(tmpdir_path, "t.csv"), os.path.join(tmpdir_path, "r.csv")
    t.target_day().write.option("header", True).option("escape", '"').csv(tgt)
    t.ref_day().write.option("header", True).option("escape", '"').csv(ref)
    rep = run(spark, tgt, ref, os.path.join(tmpdir_path, "out"), od_store=os.path.join(tmpdir_path, "od"))
    expected = E.queries()["null_report"](spark, "/root/testdata/sf0.001").first().asDict()
    assert rep == expected
    assert io.read_od(spark, os.path.join(tmpdir_path, "od")).count() == rep["total_rows"]


def test_missing_keys_match_on_request(spark):
    cols = "route_name string, board_name string, board_seq string, alight_name string, alight_seq string"
    tgt = en.normalise_target(spark.createDataFrame([("A", "S", None, "T", "2"), ("A", "S", "1", "T", None)], cols))
    ref = en.normalise_reference(spark.createDataFrame(
        [("7", "S", "1", "c1", "T", "2", "c2"), ("7", "S", None, "c0", "T", None, "c9")],
        "route_id string, board_name string, board_seq string, board_ars string, alight_name string, "
        "alight_seq string, alight_ars string"))
    drop = {(r.board_seq, r.board_code, r.alight_code) for r in en.attach_codes(tgt, ref).collect()}
    match = {(r.board_seq, r.board_code, r.alight_code) for r in en.attach_codes(tgt, ref, "match").collect()}
    assert drop == {(None, None, "c2"), ("1", "c1", None)}
    assert match == {(None, "c0", "c2"), ("1", "c1", "c9")}


def test_raw_csv_missing_tokens_and_numbers(spark, tmpdir_path):
    from odspark.functions.text import to_number
    p = os.path.join(tmpdir_path, "raw.csv")
    with open(p, "w") as f:
        f.write("a,b\nNULL,1\nnan,1d\nN/A,2f\nx, 3.5 \n,1e3\n")
    rows = io.read_raw_csv(spark, p).select("a", to_number("b").alias("b")).collect()
    assert sorted(rows, key=str) == sorted([(None, 1.0), (None, None), (None, None), ("x", 3.5), (None, 1000.0)], key=str)
