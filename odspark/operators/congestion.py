"""On-board load and relative congestion per stop (all routes, all dates).

Plan shape (one OD scan):

1. explode each OD row into a +riders boarding event and a -riders
   alighting event (no second scan, no UNION of two scans);
2. partial + final hash aggregate to one row per
   (date, route, seq, ARS, stop name) — the only shuffle of raw rows, and
   map-side combine collapses hot keys before it;
3. windows over (date, route) on that small per-stop table: running sum
   (load), route max, and per-ARS total riders. A route has at most a few
   hundred stops, so window partitions are bounded by stop count, never by
   rider volume;
4. left join to the stop-location dimension reduced to one row per
   (ARS, name); the planner broadcasts it when its measured size is under
   the threshold and sort-merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odspark.constants import LAT_RANGE, LON_RANGE, VIRTUAL_ARS
from odspark.functions.metrics import gradient_color, grade, hourly_load, pct1
from odspark.functions.text import strip_first_char

ROUTE_KEY = ["service_date", "route_name"]
STOP_KEY = ROUTE_KEY + ["seq", "ars", "stop_name"]
SECTION_COLS = ["seq", "ars", "stop_name", "load", "max_load", "pct", "grade", "color", "lat", "lon", "total_riders"]


def _filter_scope(od: DataFrame, routes=None, dates=None) -> DataFrame:
    if routes is not None:
        od = od.where(F.col("route_name").isin(list(routes)))
    if dates is not None:
        od = od.where(F.col("service_date").isin(list(dates)))
    return od


def stop_events(od: DataFrame) -> DataFrame:
    """One row per stop visit: boarding (+riders) and alighting (-riders),
    virtual stops ('00000') and NULL ARS excluded."""
    ev = od.select(
        *ROUTE_KEY,
        F.explode(F.array(
            F.struct(F.col("board_seq").cast("int").alias("seq"), F.col("board_ars").alias("ars"),
                     F.col("board_name").alias("stop_name"),
                     F.col("riders").cast("long").alias("boardings"),
                     F.lit(None).cast("long").alias("alightings")),
            F.struct(F.col("alight_seq").cast("int").alias("seq"), F.col("alight_ars").alias("ars"),
                     F.col("alight_name").alias("stop_name"),
                     F.lit(None).cast("long").alias("boardings"),
                     F.col("riders").cast("long").alias("alightings")),
        )).alias("e"))
    return ev.select(*ROUTE_KEY, "e.*").where(F.col("ars") != VIRTUAL_ARS)


def stop_flows(od: DataFrame) -> DataFrame:
    """Per (date, route, seq, ARS, name): boardings, alightings, net."""
    return (stop_events(od)
            .groupBy(*STOP_KEY)
            .agg(F.sum("boardings").alias("boardings"),
                 F.sum("alightings").alias("alightings"),
                 F.sum(F.coalesce(F.col("boardings"), -F.col("alightings"))).alias("net")))


def stop_locations(loc: DataFrame) -> DataFrame:
    """Location dimension: strip the junk first character, keep the bounding
    box, one row per (ARS, name) so the join can never fan out."""
    return (loc
            .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                   & F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE))
            .select(F.substring("stop_no", 2, 5).alias("ars"),
                    strip_first_char("stop_name").alias("stop_name"), "lat", "lon")
            .groupBy("ars", "stop_name")
            .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")))


def stop_order() -> list:
    """Deterministic stop order along a route: seq (NULLs last), ARS, name."""
    return [F.col("seq").asc_nulls_last(), F.col("ars").asc_nulls_last(),
            F.col("stop_name").asc_nulls_last()]


def congestion(od: DataFrame, loc: DataFrame | None = None, routes=None, dates=None,
               ordered: bool = False) -> DataFrame:
    """Congestion rows for every (date, route) in scope.
    ``ordered`` sorts by date, route and stop order (request-sized results)."""
    flows = stop_flows(_filter_scope(od, routes, dates))
    w_run = Window.partitionBy(*ROUTE_KEY).orderBy(*stop_order()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_route = Window.partitionBy(*ROUTE_KEY)
    w_ars = Window.partitionBy(*ROUTE_KEY, "ars")
    load = hourly_load(F.sum("net").over(w_run))
    rows = (flows
            .withColumn("load", load)
            .withColumn("max_load", F.max("load").over(w_route))
            .withColumn("total_riders",
                        (F.coalesce(F.sum("boardings").over(w_ars), F.lit(0))
                         + F.coalesce(F.sum("alightings").over(w_ars), F.lit(0))).cast("long"))
            .withColumn("pct", F.coalesce(pct1("load", "max_load"), F.lit(0.0)))
            .withColumn("grade", grade("pct"))
            .withColumn("color", gradient_color("pct")))
    if loc is not None:
        rows = rows.join(stop_locations(loc), ["ars", "stop_name"], "left")
    else:
        rows = rows.withColumn("lat", F.lit(None).cast("double")).withColumn(
            "lon", F.lit(None).cast("double"))
    rows = rows.select("service_date", "route_name", "seq", "ars", "stop_name", "load",
                       "max_load", "pct", "grade", "color", "lat", "lon", "total_riders")
    return rows.orderBy(*ROUTE_KEY, *stop_order()) if ordered else rows


def congestion_for_routes(od: DataFrame, loc: DataFrame | None, routes: str | list,
                          date: str | None = None, ordered: bool = False) -> DataFrame:
    """Comma-separated (or listed) routes, trimmed; a route named twice
    is returned once per mention. ``route_order`` is the position in the
    request; ``ordered=True`` sorts the rows as the
    endpoint returns them (request order, then stop order) — a global sort,
    meant for request-sized results."""
    names = [r.strip() for r in (routes.split(",") if isinstance(routes, str) else routes)]
    names = [n for n in names if n]
    dates = None if date is None else [date]
    rows = congestion(od, loc, routes=names, dates=dates)
    wanted = F.array(*[F.lit(n) for n in names])
    mentions = F.filter(F.sequence(F.lit(1), F.lit(max(1, len(names)))),
                        lambda i: F.get(wanted, i - 1) == F.col("route_name"))
    rows = rows.withColumn("route_order", F.explode(mentions))
    return rows.orderBy("route_order", "service_date", *stop_order()) if ordered else rows


def stops_by_route(od: DataFrame, routes=None, dates=None, ordered: bool = False) -> DataFrame:
    """Boarding stop names per route with ``pos``, their place in route
    order (seq, then name); a name repeats when it has several seqs.
    ``ordered=True`` sorts by it (request-sized results)."""
    rows = (_filter_scope(od, routes, dates)
            .where(F.col("board_ars") != VIRTUAL_ARS)
            .select("service_date", "route_name", F.col("board_name").alias("stop_name"),
                    F.col("board_seq").alias("seq")).distinct())
    place = Window.partitionBy(*ROUTE_KEY).orderBy(F.col("seq").asc_nulls_last(), F.col("stop_name").asc_nulls_last())
    rows = rows.withColumn("pos", F.row_number().over(place))
    return rows.orderBy(*ROUTE_KEY, "pos") if ordered else rows


def section_congestion(cong: DataFrame, sections: DataFrame) -> DataFrame:
    """For each request (service_date, route_name, from_name, to_name),
    the stops from the first ``from`` through the first ``to`` at or after
    it (inclusive). Missing ``to`` runs to the route end; missing ``from``
    gives no rows. Percent keeps the whole-route max.

    One array of stops per date and route (a route has hundreds of stops) is
    joined to the requests; a request looks its two stops up by position and
    explodes its own slice, so no window runs over requests times stops. A NULL
    ``from`` gives no rows, a NULL ``to`` runs to the end.
    """
    last = lambda col: (F.col(col).isNull(), F.col(col))  # noqa: E731  NULLs last
    named = [F.col(n) for n in SECTION_COLS]
    order = [x.alias(f"_o{i}") for i, x in enumerate(
        [*last("seq"), *last("ars"), *last("stop_name")])]
    routes = cong.groupBy(*ROUTE_KEY).agg(F.array_sort(F.collect_list(F.struct(*order, *named))).alias("stops"))
    req = sections.select(*ROUTE_KEY, "from_name", "to_name")
    names = F.transform("stops", lambda s: s["stop_name"])
    first = F.array_position(names, F.col("from_name")).cast("int")
    found = (routes.join(req, ROUTE_KEY).withColumn("first", first).where(F.col("first") > 0)
             .withColumn("rest", F.slice("stops", F.col("first"), F.size("stops"))))
    upto = F.array_position(F.transform("rest", lambda s: s["stop_name"]), F.col("to_name")).cast("int")
    size = F.when(upto > 0, upto).otherwise(F.size("rest"))
    out = found.select(*ROUTE_KEY, "from_name", "to_name", "first",
                       F.posexplode(F.slice("rest", F.lit(1), size)).alias("nth", "s"))
    return out.select(*ROUTE_KEY, "from_name", "to_name", (F.col("first") + F.col("nth")).alias("pos"),
                      *[F.col("s")[n].alias(n) for n in SECTION_COLS])
