"""Origin–destination lookups (all stops of all routes and dates at once).

Each is a single hash aggregate with map-side combine over the OD fact.
The per-stop request of the original (route, ARS, date) is a filter on top
of the all-stops result, so one job serves every stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odspark.constants import VIRTUAL_ARS

_DEST = ("board_ars", "alight_name", "alight_seq")
_ORIG = ("alight_ars", "board_name", "board_seq")


def _od_side(od: DataFrame, key_ars: str, other_name: str, other_seq: str,
             exclude_virtual_key: bool) -> DataFrame:
    other_ars = "alight_ars" if key_ars == "board_ars" else "board_ars"
    cond = F.col(other_ars) != VIRTUAL_ARS
    if exclude_virtual_key:
        cond = cond & (F.col(key_ars) != VIRTUAL_ARS)
    else:
        cond = cond & F.col(key_ars).isNotNull()
    return (od.where(cond)
            .groupBy("service_date", "route_name", key_ars, other_name)
            .agg(F.sum("riders").cast("long").alias("riders"),
                 F.min(other_seq).cast("int").alias("seq"))
            .select("service_date", "route_name", F.col(key_ars).alias("ars"),
                    F.col(other_name).alias("stop_name"), "riders", "seq")
            .withColumn("pos", _place("service_date", "route_name", "ars")))


def _place(*key):
    """Place of a stop in its list: by seq, then name (a list is one route's stops)."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(
        F.col("seq").asc_nulls_last(), F.col("stop_name").asc_nulls_last()))


def in_order(od_rows: DataFrame) -> DataFrame:
    """O2: OD rows by date, route, ARS and place (request-sized results)."""
    return od_rows.orderBy("service_date", "route_name", "ars", "pos")


def destinations(od: DataFrame) -> DataFrame:
    """K21 boarding side: where riders boarding at each ARS alight
    (only the alighting end's virtual stop is excluded)."""
    return _od_side(od, *_DEST, exclude_virtual_key=False)


def origins(od: DataFrame) -> DataFrame:
    """K21 alighting side: where riders alighting at each ARS boarded."""
    return _od_side(od, *_ORIG, exclude_virtual_key=False)


def od_for_stops(od: DataFrame) -> DataFrame:
    """K21 for every (date, route, ARS): both directions, tagged. One scan:
    each row is a destination entry of its boarding ARS (kept when the
    alighting end is real) and an origin entry of its alighting ARS (kept
    when the boarding end is real); one aggregate over both."""
    b, a = F.col("board_ars"), F.col("alight_ars")
    entries = od.select(
        "service_date", "route_name", "riders",
        F.explode(F.array(
            F.struct(F.lit("destination").alias("direction"), b.alias("ars"),
                     F.col("alight_name").alias("stop_name"), F.col("alight_seq").alias("seq"),
                     ((a != VIRTUAL_ARS) & b.isNotNull()).alias("keep")),
            F.struct(F.lit("origin").alias("direction"), a.alias("ars"),
                     F.col("board_name").alias("stop_name"), F.col("board_seq").alias("seq"),
                     ((b != VIRTUAL_ARS) & a.isNotNull()).alias("keep")),
        )).alias("e"))
    return (entries.where(F.col("e.keep"))
            .groupBy("service_date", "route_name", F.col("e.ars").alias("ars"),
                     F.col("e.stop_name").alias("stop_name"), F.col("e.direction").alias("direction"))
            .agg(F.sum("riders").cast("long").alias("riders"), F.min("e.seq").cast("int").alias("seq"))
            .select("service_date", "route_name", "ars", "stop_name", "riders", "seq", "direction")
            .withColumn("pos", _place("service_date", "route_name", "ars", "direction")))


def od_for_stop(od: DataFrame, route: str, ars: str, date: str) -> DataFrame:
    """K21 for one stop (filters, the stop's included, push down to the scan)."""
    here = (F.col("board_ars") == ars) | (F.col("alight_ars") == ars)
    scoped = od.where((F.col("route_name") == route) & (F.col("service_date") == date) & here)
    return od_for_stops(scoped).where(F.col("ars") == ars)


def all_boarding(od: DataFrame, dates=None) -> DataFrame:
    """K22 boarding table: both ends non-virtual."""
    if dates is not None:
        od = od.where(F.col("service_date").isin(list(dates)))
    return _od_side(od, *_DEST, exclude_virtual_key=True)


def all_alighting(od: DataFrame, dates=None) -> DataFrame:
    """K22 alighting table: both ends non-virtual."""
    if dates is not None:
        od = od.where(F.col("service_date").isin(list(dates)))
    return _od_side(od, *_ORIG, exclude_virtual_key=True)


def nested_od(od: DataFrame) -> DataFrame:
    """Per (date, route, ARS) the destination and origin lists, each
    ``array<struct<stop_name, riders>>`` in stop order (seq, then name).

    One scan: every row (both ends real) becomes a destination entry of its
    boarding ARS and an origin entry of its alighting ARS; one aggregate
    sums riders per entry; one more groups by (date, route, ARS) and builds
    both lists with ``collect_list`` over a ``when`` (NULLs are skipped), so
    no join is needed. A list is bounded by the stops of one route.
    """
    both_real = (F.col("board_ars") != VIRTUAL_ARS) & (F.col("alight_ars") != VIRTUAL_ARS)
    entries = od.where(both_real).select(
        "service_date", "route_name", "riders",
        F.explode(F.array(
            F.struct(F.lit("d").alias("dir"), F.col("board_ars").alias("ars"),
                     F.col("alight_name").alias("stop_name"), F.col("alight_seq").alias("seq")),
            F.struct(F.lit("o").alias("dir"), F.col("alight_ars").alias("ars"),
                     F.col("board_name").alias("stop_name"), F.col("board_seq").alias("seq")),
        )).alias("e"))
    per_stop = (entries.groupBy("service_date", "route_name", "e.dir", "e.ars", "e.stop_name")
                .agg(F.sum("riders").cast("long").alias("riders"), F.min("e.seq").alias("seq")))
    item = F.struct(F.coalesce(F.col("seq"), F.lit(2147483647)).alias("k1"), F.col("stop_name").alias("k2"),
                    "stop_name", "riders")
    strip_keys = lambda arr: F.transform(F.array_sort(arr), lambda x: F.struct(
        x["stop_name"].alias("stop_name"), x["riders"].alias("riders")))
    return (per_stop.groupBy("service_date", "route_name", "ars")
            .agg(F.collect_list(F.when(F.col("dir") == "d", item)).alias("d"),
                 F.collect_list(F.when(F.col("dir") == "o", item)).alias("o"))
            .select("service_date", "route_name", "ars",
                    F.when(F.size("d") > 0, strip_keys(F.col("d"))).alias("destinations"),
                    F.when(F.size("o") > 0, strip_keys(F.col("o"))).alias("origins")))
