"""Batch restores of NULL keys from master tables (J20..J22).

Only the rows whose value is NULL take part in the join; the rest are
passed through untouched, so the bulk of the table is never shuffled.

The original restored these row by row (one lookup per NULL, half an hour)
and then as one set-based UPDATE ... FROM; here each is a left join to a
master reduced to one row per key (so it cannot fan out) plus ``coalesce``.
Masters are small dimensions (stops, routes); the planner broadcasts them
when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odspark.constants import LAT_RANGE, LON_RANGE, OD_COLUMNS
from odspark.operators.congestion import stop_locations

c = F.col


def _one_per_key(df: DataFrame, key: list, value: str) -> DataFrame:
    """The value on most rows per key, then the smallest."""
    n = df.where(c(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key).orderBy(c("_n").desc(), c(value).asc())
    return n.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_n", "_rn")


def station_master(od: DataFrame, loc: DataFrame) -> DataFrame:
    """A station master (ars, stop_name, code, lat, lon): the code observed
    most often for each boarding (ARS, name) in the OD fact, located by the
    stop-location table (junk prefix stripped, one row per key)."""
    codes = _one_per_key(od.select(c("board_ars").alias("ars"), c("board_name").alias("stop_name"),
                                   c("board_code").alias("code")), ["ars", "stop_name"], "code")
    return codes.join(stop_locations(loc), ["ars", "stop_name"], "left")


def restore_codes(od: DataFrame, master: DataFrame, end: str = "board",
                  by_name: bool = True, bbox: bool = True) -> DataFrame:
    """J20 (ARS + name + bbox) / J21 (ARS only): fill NULL ``{end}_code``
    from the master."""
    m = master.where(c("code").isNotNull())
    if bbox:
        m = m.where(c("lat").between(*LAT_RANGE) & c("lon").between(*LON_RANGE))
    key = ["ars", "stop_name"] if by_name else ["ars"]
    m = _one_per_key(m.select(*key, "code"), key, "code")
    cond = c(f"{end}_ars") == c("_m_ars")
    sel = [c("ars").alias("_m_ars"), c("code").alias("_m_code")]
    if by_name:
        cond = cond & (c(f"{end}_name") == c("_m_name"))
        sel.append(c("stop_name").alias("_m_name"))
    code = f"{end}_code"
    known = od.where(c(code).isNotNull()).select(*OD_COLUMNS)   # passes through, no shuffle
    j = od.where(c(code).isNull()).join(m.select(*sel), cond, "left")
    return known.unionByName(j.select(*[c("_m_code").alias(code) if n == code else c(n)
                                         for n in OD_COLUMNS]))


def route_map(od: DataFrame) -> DataFrame:
    """A route map (route_name -> route_id) from the rows that carry both."""
    return _one_per_key(od.select("route_name", "route_id").where(c("route_name").isNotNull()),
                        ["route_name"], "route_id")


def restore_route_ids(od: DataFrame, routes: DataFrame) -> DataFrame:
    """Fill NULL route ids from a route map (one id per name)."""
    m = _one_per_key(routes, ["route_name"], "route_id").select(
        c("route_name").alias("_rn"), c("route_id").alias("_rid"))
    known = od.where(c("route_id").isNotNull()).select(*OD_COLUMNS)
    j = od.where(c("route_id").isNull()).join(m, c("route_name") == c("_rn"), "left")
    return known.unionByName(j.select(*[c("_rid").cast("long").alias("route_id") if n == "route_id"
                                         else c(n) for n in OD_COLUMNS]))
