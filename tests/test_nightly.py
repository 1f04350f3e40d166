"""The nightly job over several nights, in place, and with dates that become empty."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import od_row
from odspark.operators import correct as cr
from odspark.plans import pipeline
from odspark.session import ensure_checkpoint_dir
from odspark.sources import io
from odspark.sources.snapshots import ConcurrentRun, Snapshots

D1, D2 = "20231017", "20251014"


def rows(date, n=6):
    # the last row alights at a virtual stop early on a long route: an anomaly
    out = [od_row(date=date, bseq=i, bars=f"0100{i}", bname=f"S{i}", aseq=i + 1, aars=f"0100{i + 1}",
                  aname=f"S{i + 1}", riders=i) for i in range(1, n)]
    out.append(od_row(date=date, bseq=100, bars="01099", bname="S99", aseq=101, aars="01100", aname="S100"))
    return out


def anomaly(date):
    return od_row(date=date, bseq=20, bars="01020", bname="S20", aseq=None, aars="00000", aname="x", riders=9)


def total(df):
    return sum(r.riders for r in df.collect())


def test_two_nights_with_one_staging_path(spark, make_od, tmpdir_path):
    src, out, stage, anom = (f"{tmpdir_path}/{x}" for x in ("src", "out", "stage", "anom"))
    io.write_od(make_od(rows(D1) + rows(D2) + [anomaly(D1)]), src)
    for d in (D1, D2):
        pipeline.run_nightly(spark, src, out, stage, anom, dates=[d])
    assert total(io.read_od(spark, out)) == total(make_od(rows(D1) + rows(D2)))
    assert total(io.read_od(spark, anom)) == 9
    assert not glob.glob(f"{stage}/run-*")


def test_in_place_is_refused_for_plain_tables(spark, make_od, tmpdir_path):
    io.write_od(make_od(rows(D1)), f"{tmpdir_path}/od")
    with pytest.raises(ValueError, match="run_snapshot"):
        pipeline.run_nightly(spark, f"{tmpdir_path}/od", f"{tmpdir_path}/od/", f"{tmpdir_path}/s", f"{tmpdir_path}/a", [D1])
    assert total(io.read_od(spark, f"{tmpdir_path}/od")) == total(make_od(rows(D1)))


def held(store):
    """Riders per table and date."""
    return {(t, r[0]): r[1] for t in ("input", "od", "anomalies")
            for r in store.read(t).groupBy("service_date").sum("riders").collect()}


def test_command_line_repeats_in_place_without_loss(spark, make_od, tmpdir_path):
    src, root, rep = (f"{tmpdir_path}/{x}" for x in ("src", "store", "rep"))
    io.write_od(make_od(rows(D1) + rows(D2) + [anomaly(D1), anomaly(D2)]), src)
    staged = f"{ensure_checkpoint_dir(spark)}/odspark-tables"
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    args = ["--store", root, "--report", rep]
    pipeline.main(args + ["--od", src, "--date", D1, "--date", D2])
    assert set(os.listdir(staged)) == before  # nothing is left staged
    assert spark.read.parquet(rep).count() == 2
    store, want = Snapshots(spark, root), total(make_od(rows(D1)))
    once = held(store)
    assert once == {(t, d): n for d in (D1, D2) for t, n in (("input", want + 9), ("od", want), ("anomalies", 9))}
    rows_once = sorted(map(tuple, store.read("od").collect()))
    for dates in ([D1], [D1, D2]):
        pipeline.main(args + [x for d in dates for x in ("--date", d)])
        assert held(store) == once and sorted(map(tuple, store.read("od").collect())) == rows_once
    # new input without the anomaly, and then without rows, for one date only
    io.write_od(make_od(rows(D1)), src, dates=[D1])
    pipeline.main(args + ["--od", src, "--date", D1])
    assert held(store) == {k: v for k, v in once.items() if k != ("anomalies", D1)} | {("input", D1): want}
    pipeline.run_snapshot(store, [D1], source=make_od([]))
    assert held(store) == {k: v for k, v in once.items() if k[1] == D2}
    # an older version still reads what it held
    assert store.read("anomalies", [D1], version=1).count() == 1
    assert store.vacuum() > 0 and held(store) == {k: v for k, v in once.items() if k[1] == D2}
    assert store.versions() == [5]


@pytest.mark.parametrize("killed_at", ["input", "od", "anomalies", "switch"])
def test_a_killed_run_changes_nothing(spark, make_od, tmpdir_path, monkeypatch, killed_at):
    store = Snapshots(spark, f"{tmpdir_path}/store")
    pipeline.run_snapshot(store, [D1], source=make_od(rows(D1) + [anomaly(D1)]))
    before = held(store)
    write, switch = Snapshots.write, Snapshots.switch

    def dying_write(self, run, table, df):
        out = write(self, run, table, df)
        if table == killed_at:
            raise KeyboardInterrupt
        return out

    def dying_switch(self, *args):
        raise KeyboardInterrupt
    monkeypatch.setattr(Snapshots, "write", dying_write)
    if killed_at == "switch":
        monkeypatch.setattr(Snapshots, "switch", dying_switch)
    more = make_od(rows(D1) + rows(D1) + [anomaly(D1), anomaly(D1)])
    with pytest.raises(KeyboardInterrupt):
        pipeline.run_snapshot(store, [D1], source=more)
    monkeypatch.setattr(Snapshots, "write", write)
    monkeypatch.setattr(Snapshots, "switch", switch)
    assert held(store) == before and store.vacuum() > 0 and held(store) == before
    pipeline.run_snapshot(store, [D1], source=more)
    after = held(store)
    assert after[("input", D1)] == after[("od", D1)] + after[("anomalies", D1)] == 2 * before[("input", D1)]


def test_lost_riders_and_concurrent_runs_are_refused(spark, make_od, tmpdir_path, monkeypatch):
    store = Snapshots(spark, f"{tmpdir_path}/store")
    pipeline.run_snapshot(store, [D1], source=make_od(rows(D1)))
    seen, before = store.pointer(), held(store)
    write = Snapshots.write
    monkeypatch.setattr(Snapshots, "write", lambda self, run, table, df: write(self, run, table, df.limit(2)))
    with pytest.raises(ValueError, match="riders not conserved"):
        pipeline.run_snapshot(store, [D1])
    monkeypatch.setattr(Snapshots, "write", write)
    pipeline.run_snapshot(store, [D1])  # meanwhile
    run = store.new_run()
    store.write(run, "od", make_od(rows(D1)))
    with pytest.raises(ConcurrentRun):
        store.switch(run, ["od"], [D1], seen)
    store.write(run, "anomalies", make_od([anomaly(D2)]))
    store.switch(run, ["anomalies"], [D2], seen)  # other dates do not meet
    assert held(store) == before | {("anomalies", D2): 9}


def test_files_per_date_stay_bounded(spark, make_od, tmpdir_path):
    path = f"{tmpdir_path}/many"
    io.write_od(make_od((rows(D1) + rows(D2)) * 20).repartition(32), path)
    assert all(len(glob.glob(f"{path}/service_date={d}/*.parquet")) <= 2 for d in (D1, D2))


def test_materialize_raises_on_other_errors(spark, make_od, tmpdir_path):
    path = f"{tmpdir_path}/stored"
    io.materialize(make_od(rows(D1)), path)
    for f in glob.glob(f"{path}/*.parquet"):
        with open(f, "wb") as h:
            h.write(b"not parquet")
    with pytest.raises(Exception):
        io.materialize(make_od(rows(D2)), path).count()
    assert all(open(f, "rb").read() == b"not parquet" for f in glob.glob(f"{path}/*.parquet"))


def test_code_update_rewrites_touched_dates_only(spark, make_od, tmpdir_path):
    days = ["20231017", "20241019", "20251014"]
    store = Snapshots(spark, os.path.join(tmpdir_path, "store"))
    pipeline.run_snapshot(store, days, source=make_od([od_row(date=d, bcode=None if i else "c0", riders=5 + i)
                                              for i, d in enumerate(days)]))
    before, riders = store.pointer(), [r.riders for r in store.read("od").orderBy("service_date").collect()]
    updates = spark.createDataFrame(
        [(days[1], "R1", "01001", "01002", "new"), (days[2], "R1", "01001", "01002", None),
         ("19990101", "R1", "01001", "01002", "x")],
        "service_date string, route_name string, board_ars string, alight_ars string, code string")
    assert pipeline.update_codes(store, updates) == [days[1]]
    after = store.pointer()
    assert {k for k in after if after[k] != before[k]} == {("input", days[1]), ("od", days[1])}
    for table in ("input", "od"):
        assert [r.board_code == "new" for r in store.read(table).orderBy("service_date").collect()] == [False, True, False]
    assert [r.riders for r in store.read("od").orderBy("service_date").collect()] == riders
    assert pipeline.update_codes(store, updates.where("code = 'x'")) == []
    pipeline.run_snapshot(store, days)  # the update outlives a repeated run
    assert [r.board_code for r in store.read("od", [days[1]]).collect()] == ["new"]


def test_group_one_is_folded_before_it_is_stored(spark, make_od, monkeypatch):
    taken = [anomaly(D1), anomaly(D1)[:-1] + (None,), anomaly(D2), anomaly(D2)[:-1] + (4,)]
    virtual = [od_row(date=D2, bars=None, bname="기점가상1", bseq=None, riders=n) for n in (1, None, 2)]
    once = rows(D1) + rows(D2) + taken + virtual
    od, seen, cut = make_od(once * 25 + taken), {}, pipeline.cut_lineage

    def counted(df, name="stage"):
        out = cut(df, name)
        seen[name] = out.count()
        return out
    monkeypatch.setattr(pipeline, "cut_lineage", counted)
    monkeypatch.setattr(cr, "COPIES", 4, raising=False)
    res = pipeline.correct_all(od)
    assert seen["group1"] <= len(once) < od.count()
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(res.anomalies) == text(cr.anomaly_rows(od)) and res.anomalies.count() == 26 * len(taken)
    assert text(res.corrected) == text(cr.correct_pipeline(od))
    tagged = cr.group1_tagged(od)
    want = tagged.groupBy("service_date").agg(*[F.count_if(F.col(t)).alias(t[2:]) for t in cr.tags(tagged)])
    assert text(res.step_counts) == text(want)
    assert res.riders_in == od.agg(F.sum("riders")).first()[0]
