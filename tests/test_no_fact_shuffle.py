"""Corrections do not shuffle the fact while the small side fits, and split or
bypass a hot key beyond that."""

import re

import pytest

from conftest import od_row, rows_of
from odspark.operators import correct as cr

STEPS = {
    "c5": cr.c5_terminal_virtual_seq, "k10": cr.k10_seq_by_mode, "k11": cr.k11_alight_seq_spread,
    "k11g": cr.sequence_fixes, "k12b": cr.k12b_same_stop_by_ars, "k13": cr.fill_null_codes,
}


def hot_rows(n=900):
    """A third of the rows at the virtual stop, the rest over a few stops."""
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append(od_row(bars="00000", bseq=0 if i % 2 else None, bcode=None, aseq=None if i % 6 else 3,
                              aars="00000" if i % 6 else "01003", bname="x", riders=i))
        else:
            s = i % 17 + 1
            out.append(od_row(date="20251014" if i % 5 else "20231017", bseq=s + (i % 29 == 0), bars=f"010{s:02}",
                              bcode=None if i % 4 == 0 else f"c{s}", bname=f"S{s}", aseq=s + 1 + i % 2,
                              aars=f"010{s + (i % 7 != 0):02}", aname=f"S{s + 1}", riders=i))
    return out


@pytest.mark.parametrize("name", sorted(STEPS))
def test_fact_is_not_exchanged(spark, make_od, tmpdir_path, name):
    make_od(hot_rows()).repartition(4).write.parquet(f"{tmpdir_path}/od")
    od = spark.read.parquet(f"{tmpdir_path}/od")
    expected = rows_of(STEPS[name](make_od(hot_rows())))
    key = "spark.sql.autoBroadcastJoinThreshold"
    saved = spark.conf.get(key)
    try:
        # below the fact's size, above that of the staged statistics
        spark.conf.set(key, "12000")
        df = STEPS[name](od)
        assert rows_of(df) == expected
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, saved)
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final
    assert not re.search(r"Exchange hashpartitioning", final)


@pytest.mark.parametrize("name", ["k10", "k11", "k13"])
def test_hot_virtual_stop_is_dealt_evenly(spark, make_od, tmpdir_path, name):
    """Rows at the virtual stop are no candidates: beyond the broadcast limit
    they have keys of their own, and the fact is still read once by the join."""
    make_od(hot_rows()).write.parquet(f"{tmpdir_path}/od")
    od = spark.read.parquet(f"{tmpdir_path}/od")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = STEPS[name](od)
        got = rows_of(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == rows_of(STEPS[name](make_od(hot_rows())))
    assert "SortMergeJoin" in plan
    if name == "k13":  # filled rows are split off by a filter that reaches the scan
        assert "Union" in plan
    else:
        assert "Union" not in plan and re.search(r"Exchange hashpartitioning\([^)]*_own_deal", plan)


@pytest.mark.parametrize("name", sorted(set(STEPS) - {"k13"}))
def test_one_scan_of_the_fact(spark, make_od, tmpdir_path, name):
    """Statistics are staged before; the corrected rows come from one scan."""
    make_od(hot_rows()).write.parquet(f"{tmpdir_path}/od")
    plan = STEPS[name](spark.read.parquet(f"{tmpdir_path}/od"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*riders#", plan)) == 1 and "Union" not in plan


def test_best_donor_of_another_date(spark, make_od):
    """K13 against all pairs of targets and codes, with ties and dates that hold the most frequent codes."""
    import random
    from collections import Counter
    r = random.Random(12)
    rows = [od_row(date=f"2023{r.randrange(1, 7):02}01", bars=r.choice(["a", "a", "b", None]),
                   bcode=r.choice([None, None, "c1", "c2", "c3", "c4", "c5"]), riders=i) for i in range(300)]
    rows += [od_row(date="20230901", bars="z", bcode=None, riders=900), od_row(date="20230901", bars="z", bcode="own", riders=901),
             od_row(date="20230902", bars="y", bcode=None, riders=902)]
    got = {x.riders: x.board_code for x in cr.fill_null_codes(make_od(rows)).collect()}
    for date, ars, code, riders in [(x[0], x[4], x[5], x[-1]) for x in rows]:
        if code is None and ars is not None:
            n = Counter(x[5] for x in rows if x[4] == ars and x[5] is not None and x[0] != date)
            code = min(n, key=lambda k: (-n[k], k), default=None)
        assert got[riders] == code
