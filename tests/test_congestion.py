"""Congestion, sections and OD lookups on micro-tables."""

from pyspark.sql import functions as F

from conftest import od_row, rows_of
from odspark.operators import congestion as cg
from odspark.operators import layers as ly


def test_zero_route(make_od):
    # every boarding immediately alights: loads never positive
    od = make_od([od_row(bseq=1, aseq=1, bars="01001", aars="01001", bname="S1", aname="S1",
                         riders=5)])
    out = cg.congestion(od).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.load, r.max_load, r.pct, r.grade, r.color) == (0, 0, 0.0, "쾌적", "#00FF00")


def _route(make_od):
    # stops A(1) B(2) C(3) D(4): 38 board at A -> C, 19 board at B -> D
    return make_od([
        od_row(bseq=1, bars="00001", bname="A", aseq=3, aars="00003", aname="C", riders=38),
        od_row(bseq=2, bars="00002", bname="B", aseq=4, aars="00004", aname="D", riders=19),
        od_row(bseq=2, bars="00000", bname="가상", aseq=4, aars="00004", aname="D", riders=100),
    ])


def test_load_and_total_riders(make_od):
    out = {r.stop_name: r for r in cg.congestion(_route(make_od)).collect()}
    # on board after A: 38 -> 2; after B: 57 -> 3; after C: 19 -> 1; after D: 0
    assert [out[s].load for s in "ABCD"] == [2, 3, 1, 0]
    assert out["B"].pct == 100.0 and out["A"].pct == 66.7
    # the virtual boarding end is excluded, its alighting end at D is not
    assert out["D"].total_riders == 119 and out["A"].total_riders == 38


def test_section_cases(make_od, spark):
    cong = cg.congestion(_route(make_od))
    reqs = spark.createDataFrame([
        ("20231017", "R1", "B", "C"),        # plain
        ("20231017", "R1", "C", "A"),        # 'to' only before 'from' -> to route end
        ("20231017", "R1", "Z", "C"),        # 'from' missing -> nothing
        ("20231017", "R1", "B", "B"),        # from = to -> one row
    ], "service_date string, route_name string, from_name string, to_name string")
    out = cg.section_congestion(cong, reqs)
    got = {}
    for r in out.collect():
        got.setdefault((r.from_name, r.to_name), []).append((r.pos, r.stop_name))
    assert sorted(got[("B", "C")]) == [(2, "B"), (3, "C")]
    assert sorted(got[("C", "A")]) == [(3, "C"), (4, "D")]
    assert ("Z", "C") not in got
    assert got[("B", "B")] == [(2, "B")]


def test_multi_route_order(make_od):
    od = _route(make_od).union(make_od([od_row(route="R2", riders=3)]))
    out = cg.congestion_for_routes(od, None, " R2, R1 ")
    orders = {r.route_name: r.route_order for r in out.collect()}
    assert orders == {"R2": 1, "R1": 2}


def test_determinism_under_repartition(make_od):
    od = _route(make_od)
    a = rows_of(cg.congestion(od.repartition(1)))
    b = rows_of(cg.congestion(od.repartition(17)))
    assert a == b


def test_density_and_network(make_od):
    cong = cg.congestion(_route(make_od)).withColumn("lat", F.lit(37.5)).withColumn("lon", F.lit(127.0))
    net = {r.stop_name: r.network_pct for r in ly.network_congestion(cong).collect()}
    assert net["B"] == 100.0
    dens = ly.stop_density(cong).collect()
    assert max(r.density_pct for r in dens) == 100.0


def test_multi_route_endpoint_order(make_od):
    od = _route(make_od).union(make_od([od_row(route="R2", riders=3)]))
    out = cg.congestion_for_routes(od, None, "R2,R1", ordered=True).collect()
    assert [r.route_name for r in out][:2] == ["R2", "R2"]
    r1 = [r.seq for r in out if r.route_name == "R1"]
    assert r1 == sorted(r1)
