"""Transaction reports on micro-tables."""

import datetime as dt

from odspark.operators import reports as rp

TX = ("route_id long, board_stop_id long, alight_stop_id long, board_ts timestamp_ntz, riders int, "
      "transfer_cnt int, user_type string, distance_m int, ride_sec int")


def ts(h):
    return dt.datetime(2024, 1, 1, h, 30)


def test_distance_bands_null_goes_last(spark):
    tx = spark.createDataFrame([(1, 1, 2, ts(8), 5, 0, "A", 2999, 60), (1, 1, 2, ts(8), 3, 0, "A", 3000, 60),
                                (1, 1, 2, ts(8), 2, 0, "A", None, 60), (1, 1, 2, ts(8), 10, 0, "A", 25000, 60)], TX)
    got = {r.distance_band: (r.riders, r.pct) for r in rp.distance_band_distribution(tx).collect()}
    assert got == {"3km 미만": (5, 25.0), "3~5km": (3, 15.0), "20km 이상": (12, 60.0)}


def test_peak_hours_inclusive(spark):
    tx = spark.createDataFrame([(1, 1, 2, ts(h), 1, 0, "A", 100, 10) for h in (6, 7, 9, 10, 17, 18, 20, 21)], TX)
    routes = spark.createDataFrame([(1, "R1")], "route_id long, route_name string")
    r = rp.peak_concentration(tx, routes).first()
    assert (r.morning_riders, r.evening_riders, r.total_riders) == (2, 2, 8)
    assert (r.morning_pct, r.evening_pct) == (25.0, 25.0)


def test_top_k_ties_are_deterministic(spark):
    stops = spark.createDataFrame([(i, f"P{i}", "R1", i) for i in range(30)],
                                  "stop_id long, stop_name string, route_name string, stop_seq int")
    tx = spark.createDataFrame([(1, i, 0, ts(8), 1, 0, "A", 100, 10) for i in range(30)], TX)
    a = [tuple(r) for r in rp.top_boarding_stops(tx.repartition(1), stops).collect()]
    b = [tuple(r) for r in rp.top_boarding_stops(tx.repartition(7), stops).collect()]
    assert a == b and len(a) == 20 and a[0][0] == "P0"


def test_mean_rounding_half_up(spark):
    tx = spark.createDataFrame([(1, 1, 2, ts(8), 1, 0, "A", 1, 1), (1, 1, 2, ts(8), 1, 0, "A", 2, 2),
                                (1, 1, 2, ts(8), 1, 0, "A", 2, 2), (1, 1, 2, ts(8), 1, 0, "A", 2, 1)], TX)
    routes = spark.createDataFrame([(1, "R1")], "route_id long, route_name string")
    r = rp.route_distance_time(tx, routes).first()
    assert (r.avg_distance_m, r.avg_ride_sec) == (1.8, 1.5)   # 7/4 = 1.75 -> 1.8; 6/4 = 1.5
