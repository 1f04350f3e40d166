"""Spark results against plain-Python brute force on random micro OD tables."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from odspark.operators import congestion as cg
from odspark.operators import correct as cr
from odspark.schema import OD_SCHEMA

ARS = st.sampled_from(["00000", "01001", "01002", "01003", None])
NAME = st.sampled_from(["A", "B", "C"])
SEQ = st.one_of(st.none(), st.integers(min_value=0, max_value=4))
ROW = st.tuples(st.sampled_from(["20231017", "20251014"]), st.sampled_from(["R1", "R2"]),
                st.just(1), SEQ, ARS, st.just("c"), NAME, SEQ, ARS, st.just("d"), NAME,
                st.integers(min_value=0, max_value=60))
SETTINGS = settings(max_examples=8, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _order(k):
    seq, ars, name = k
    return (seq is None, seq if seq is not None else 0, ars is None, ars or "", name is None, name or "")


def brute_congestion(rows):
    net, board, alight = defaultdict(int), defaultdict(int), defaultdict(int)
    for (d, r, _rid, bseq, bars, _bc, bname, aseq, aars, _ac, aname, n) in rows:
        if bars is not None and bars != "00000":
            net[(d, r, bseq, bars, bname)] += n
            board[(d, r, bars)] += n
        if aars is not None and aars != "00000":
            net[(d, r, aseq, aars, aname)] -= n
            alight[(d, r, aars)] += n
    by_route = defaultdict(list)
    for (d, r, seq, ars, name), v in net.items():
        by_route[(d, r)].append(((seq, ars, name), v))
    out = {}
    for (d, r), stops in by_route.items():
        stops.sort(key=lambda kv: _order(kv[0]))
        run, loads = 0, []
        for key, v in stops:
            run += v
            loads.append((key, 0 if run < 0 else (2 * run + 19) // 38))
        mx = max(l for _, l in loads)
        for (seq, ars, name), load in loads:
            pct = ((2000 * load + mx) // (2 * mx)) / 10.0 if mx > 0 else 0.0
            out[(d, r, seq, ars, name)] = (load, mx, pct, board[(d, r, ars)] + alight[(d, r, ars)])
    return out


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=30))
def test_congestion_matches_brute_force(spark, rows):
    got = {(r.service_date, r.route_name, r.seq, r.ars, r.stop_name):
           (r.load, r.max_load, r.pct, r.total_riders)
           for r in cg.congestion(spark.createDataFrame(rows, OD_SCHEMA)).collect()}
    assert got == brute_congestion(rows)


def brute_mode(rows):
    counts = defaultdict(Counter)
    for (d, r, _rid, bseq, bars, *_rest) in rows:
        if bars is not None and bars != "00000":
            counts[(d, r, bars)][bseq] += 1
    mode = {}
    for k, c in counts.items():
        mode[k] = sorted(c.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or 0))[0][0]
    out = []
    for row in rows:
        d, r, bseq, bars = row[0], row[1], row[3], row[4]
        m = mode.get((d, r, bars))
        new = m if (bseq is not None and m is not None and bseq != m) else bseq
        out.append(new)
    return sorted(out, key=lambda x: (x is None, x or 0))


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=30))
def test_seq_mode_matches_brute_force(spark, rows):
    got = [r.board_seq for r in cr.k10_seq_by_mode(spark.createDataFrame(rows, OD_SCHEMA)).collect()]
    assert sorted(got, key=lambda x: (x is None, x or 0)) == brute_mode(rows)


def brute_section(stops, frm, to):
    """The loop: walk the stops in order; start at the first ``frm``; keep
    rows; stop after the first ``to`` once started."""
    out, started = [], False
    for pos, name in stops:
        if name == frm:
            started = True
        if started:
            out.append(pos)
        if started and name == to:
            break
    return out


@SETTINGS
@given(names=st.lists(st.sampled_from(["A", "B", "C", "D"]), min_size=1, max_size=12),
       frm=st.sampled_from(["A", "B", "C", "D", "Z"]), to=st.sampled_from(["A", "B", "C", "D", "Z"]))
def test_section_matches_loop(spark, names, frm, to):
    rows = [("20231017", "R1", i + 1, f"{i:05d}", n, 0, 0, 0.0, "쾌적", "#00FF00", None, None, 0)
            for i, n in enumerate(names)]
    cong = spark.createDataFrame(rows, "service_date string, route_name string, seq int, ars string, "
                                       "stop_name string, load bigint, max_load bigint, pct double, "
                                       "grade string, color string, lat double, lon double, "
                                       "total_riders bigint")
    req = spark.createDataFrame([("20231017", "R1", frm, to)],
                                "service_date string, route_name string, from_name string, to_name string")
    got = sorted(r.pos for r in cg.section_congestion(cong, req).collect())
    assert got == brute_section([(i + 1, n) for i, n in enumerate(names)], frm, to)


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=40))
def test_fused_group2_equals_stepwise_random(spark, rows):
    from conftest import rows_of
    od = spark.createDataFrame(rows, OD_SCHEMA)
    a = rows_of(cr.od_only(cr.k11_alight_seq_spread(cr.k10_seq_by_mode(od))))
    b = rows_of(cr.od_only(cr.sequence_fixes(od)))
    assert a == b
