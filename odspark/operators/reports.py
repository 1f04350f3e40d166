"""Transaction reports over the trip-level fact (``tx``) with the route and
stop dimensions.

Each report is one aggregate (partial + final) and at most two dimension
joins; the planner broadcasts a dimension only when its measured size is
under the threshold. Shares of a grand total are computed on the already
aggregated rows (a handful of groups), never over raw trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odspark.constants import EVENING_PEAK, MORNING_PEAK
from odspark.functions.metrics import distance_band, pct1

c = F.col


def round1_mean(total, n) -> Column:
    """``round(total / n, 1)`` half up, exact, for non-negative integers."""
    s, k = F.col(total).cast("long"), F.col(n).cast("long")
    return F.floor((s * 20 + k) / (k * 2)).cast("long") / F.lit(10.0)


def _share(df: DataFrame, measure: str) -> DataFrame:
    """Share of the grand total, 1 decimal. ``df`` is already aggregated to
    a few rows, so the unpartitioned window is tiny."""
    return df.withColumn("pct", pct1(c(measure), F.sum(measure).over(Window.partitionBy())))


def total_rows(tx: DataFrame) -> DataFrame:                       # Q1
    return tx.agg(F.count(F.lit(1)).alias("total_rows"))


def riders_by_route(tx: DataFrame, routes: DataFrame) -> DataFrame:   # Q2
    return (tx.join(routes, "route_id").groupBy("route_name")
            .agg(F.sum("riders").cast("long").alias("total_riders"),
                 F.count(F.lit(1)).alias("trips"))
            .orderBy(c("total_riders").desc(), "route_name"))


def riders_by_hour(tx: DataFrame) -> DataFrame:                   # Q3
    return (tx.groupBy(F.hour("board_ts").alias("hour"))
            .agg(F.sum("riders").cast("long").alias("riders"), F.count(F.lit(1)).alias("trips"))
            .orderBy("hour"))


def riders_by_route_hour(tx: DataFrame, routes: DataFrame) -> DataFrame:   # Q4
    return (tx.join(routes, "route_id")
            .groupBy("route_name", F.hour("board_ts").alias("hour"))
            .agg(F.sum("riders").cast("long").alias("riders"))
            .orderBy("route_name", "hour"))


def peak_concentration(tx: DataFrame, routes: DataFrame) -> DataFrame:   # Q5
    h = F.hour("board_ts")
    peak = lambda lo_hi: F.sum(F.when(h.between(*lo_hi), c("riders")).otherwise(0)).cast("long")
    agg = (tx.join(routes, "route_id").groupBy("route_name")
           .agg(peak(MORNING_PEAK).alias("morning_riders"), peak(EVENING_PEAK).alias("evening_riders"),
                F.sum("riders").cast("long").alias("total_riders")))
    return (agg.withColumn("morning_pct", pct1("morning_riders", "total_riders"))
            .withColumn("evening_pct", pct1("evening_riders", "total_riders"))
            .orderBy(c("total_riders").desc(), "route_name"))


def _top_stops(tx: DataFrame, stops: DataFrame, stop_col: str, measure: str, k: int) -> DataFrame:
    s = stops.select(c("stop_id").alias(stop_col), "stop_name", "route_name")
    return (tx.join(s, stop_col).groupBy("stop_name", "route_name")
            .agg(F.sum("riders").cast("long").alias(measure))
            .orderBy(c(measure).desc(), "stop_name", "route_name").limit(k))


def top_boarding_stops(tx, stops, k: int = 20):                    # Q6
    return _top_stops(tx, stops, "board_stop_id", "board_riders", k)


def top_alighting_stops(tx, stops, k: int = 20):                   # Q7
    return _top_stops(tx, stops, "alight_stop_id", "alight_riders", k)


def _pairs(tx: DataFrame, stops: DataFrame) -> DataFrame:
    """Role-playing double join of the stop dimension (boarding, alighting). Riders are
    added up per pair of stop ids first, so that names are joined to pairs, not to trips."""
    s1 = stops.select(c("stop_id").alias("board_stop_id"), c("stop_name").alias("board_stop"),
                      c("route_name").alias("board_route"), c("stop_seq").alias("board_stop_seq"))
    s2 = stops.select(c("stop_id").alias("alight_stop_id"), c("stop_name").alias("alight_stop"),
                      c("stop_seq").alias("alight_stop_seq"))
    ids = tx.groupBy("board_stop_id", "alight_stop_id").agg(F.sum("riders").alias("riders"))
    return ids.join(s1, "board_stop_id").join(s2, "alight_stop_id")


def section_pairs(tx, stops, seq_from: int, seq_to: int, route: str | None = None) -> DataFrame:  # Q8
    """Riders per (boarding stop, alighting stop) inside a seq range, for one
    route or — ``route=None`` — every route at once; ``pos`` is the pair's
    place within its route by descending riders."""
    p = _pairs(tx, stops).where(c("board_stop_seq").between(seq_from, seq_to)
                                & c("alight_stop_seq").between(seq_from, seq_to))
    if route is not None:
        p = p.where(c("board_route") == route)
    out = (p.groupBy(c("board_route").alias("route_name"), "board_stop", "alight_stop")
           .agg(F.sum("riders").cast("long").alias("riders")))
    place = Window.partitionBy("route_name").orderBy(c("riders").desc(), "board_stop", "alight_stop")
    return out.withColumn("pos", F.row_number().over(place))


def top_od_pairs(tx, stops, k: int = 20) -> DataFrame:             # Q9
    return (_pairs(tx, stops).groupBy(c("board_route").alias("route_name"), "board_stop", "alight_stop")
            .agg(F.sum("riders").cast("long").alias("riders"))
            .orderBy(c("riders").desc(), "route_name", "board_stop", "alight_stop").limit(k))


def transfer_distribution(tx) -> DataFrame:                        # Q10
    agg = tx.groupBy("transfer_cnt").agg(F.sum("riders").cast("long").alias("riders"))
    return _share(agg, "riders").orderBy("transfer_cnt")


def user_type_distribution(tx) -> DataFrame:                       # Q11
    agg = tx.groupBy("user_type").agg(F.sum("riders").cast("long").alias("riders"))
    return _share(agg, "riders").orderBy(c("riders").desc(), "user_type")


def route_distance_time(tx, routes) -> DataFrame:                  # Q12
    agg = (tx.join(routes, "route_id").groupBy("route_name")
           .agg(F.sum("distance_m").cast("long").alias("_d"), F.count("distance_m").alias("_nd"),
                F.sum("ride_sec").cast("long").alias("_t"), F.count("ride_sec").alias("_nt"),
                F.sum("riders").cast("long").alias("total_riders")))
    return (agg.select("route_name", round1_mean("_d", "_nd").alias("avg_distance_m"),
                       round1_mean("_t", "_nt").alias("avg_ride_sec"), "total_riders")
            .orderBy(c("total_riders").desc(), "route_name"))


def distance_band_distribution(tx) -> DataFrame:                   # Q13
    agg = (tx.groupBy(distance_band("distance_m").alias("distance_band"))
           .agg(F.sum("riders").cast("long").alias("riders")))
    return _share(agg, "riders").orderBy(c("riders").desc(), "distance_band")
