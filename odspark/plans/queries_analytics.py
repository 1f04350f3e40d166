"""Registered analytics queries: congestion, sections, stop lists, OD, map layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from odspark.operators import congestion as cg
from odspark.operators import layers as ly
from odspark.operators import od as odo
from odspark.plans import maps
from odspark.plans import oracle as O
from odspark.plans.registry import T, register
from odspark.session import cut_lineage, staged_path
from odspark.sources import io
from odspark.sources.fixtures import oracle_with

V = O.V

# --------------------------------------------------------------------------
# Several routes in one job, in the requested order (all ten routes,
# out of order, with stray spaces and one named twice, as the endpoint receives them)
ROUTE_LIST = " R3, R0,R7 ,R1,R9, R2,R5,R8 , R4,R6,R3"


def _k19_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes()
            + f"""SELECT {O.CONG_COLS},
  CAST(route_order AS INTEGER) AS route_order
FROM cong JOIN (SELECT unnest(['R3','R0','R7','R1','R9','R2','R5','R8','R4','R6','R3']) AS route_name,
                       unnest(range(1, 12)) AS route_order) req USING (route_name)""")


@register("congestion_multi", _k19_sql)
def congestion_multi(spark, sf_dir):
    t = T(spark, sf_dir)
    return cg.congestion_for_routes(t.od(), t.loc(), ROUTE_LIST)


# --------------------------------------------------------------------------
# K20
def _k20_sql():
    return oracle_with("od") + f"""
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY service_date, route_name ORDER BY seq NULLS LAST, stop_name NULLS LAST)
               AS INTEGER) AS pos
FROM (SELECT DISTINCT service_date, route_name, board_name AS stop_name, CAST(board_seq AS INTEGER) AS seq
      FROM od WHERE board_ars <> {V}) x"""


@register("stops_by_route", _k20_sql)
def stops_by_route(spark, sf_dir):
    return cg.stops_by_route(T(spark, sf_dir).od())


# --------------------------------------------------------------------------
# Section requests derived from the routes and dates present: a plain
# section, a 'to' that only occurs before 'from', a missing 'from', from = to
def _section_requests(t):
    od = t.od()
    base = F.col("route_name").substr(2, 10).cast("int") * 1000
    s = lambda off: F.concat(F.lit("S"), (base + off).cast("string"))
    reqs = F.array(
        F.struct(s(5).alias("from_name"), s(20).alias("to_name")),
        F.struct(s(10).alias("from_name"), s(2).alias("to_name")),
        F.struct(F.lit("nowhere").alias("from_name"), s(3).alias("to_name")),
        F.struct(s(7).alias("from_name"), s(7).alias("to_name")))
    return (od.select("service_date", "route_name").distinct()
            .select("service_date", "route_name", F.explode(reqs).alias("r"))
            .select("service_date", "route_name", "r.from_name", "r.to_name"))


def _k16_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes() + """,
req AS (SELECT DISTINCT service_date, route_name, from_name, to_name FROM (
  SELECT service_date, route_name, CAST(substring(route_name, 2) AS INTEGER) * 1000 AS base FROM od) q,
  (SELECT 5 AS f, 20 AS t, 0 AS miss UNION ALL SELECT 10, 2, 0 UNION ALL SELECT 0, 3, 1 UNION ALL SELECT 7, 7, 0) v(f, t, miss)
  CROSS JOIN LATERAL (SELECT CASE WHEN miss = 1 THEN 'nowhere' ELSE concat('S', CAST(base + f AS VARCHAR)) END AS from_name,
                             concat('S', CAST(base + t AS VARCHAR)) AS to_name) n),
ranked AS (SELECT c.*, CAST(row_number() OVER (PARTITION BY service_date, route_name
             ORDER BY seq ASC NULLS LAST, ars ASC NULLS LAST, stop_name ASC NULLS LAST) AS INTEGER) AS pos FROM cong c),
bounds AS (
  SELECT q.*, (SELECT MIN(r.pos) FROM ranked r WHERE r.service_date = q.service_date
                 AND r.route_name = q.route_name AND r.stop_name = q.from_name) AS from_pos
  FROM req q),
bounds2 AS (
  SELECT b.*, (SELECT MIN(r.pos) FROM ranked r WHERE r.service_date = b.service_date
                 AND r.route_name = b.route_name AND r.stop_name = b.to_name AND r.pos >= b.from_pos) AS to_pos
  FROM bounds b)
SELECT r.service_date, r.route_name, b.from_name, b.to_name, r.pos, r.seq, r.ars, r.stop_name, r.load,
       r.max_load, r.pct, r.grade, r.color, r.lat, r.lon, r.total_riders
FROM bounds2 b JOIN ranked r ON r.service_date = b.service_date AND r.route_name = b.route_name
WHERE b.from_pos IS NOT NULL AND r.pos >= b.from_pos AND (b.to_pos IS NULL OR r.pos <= b.to_pos)""")


@register("section_congestion", _k16_sql)
def section_congestion(spark, sf_dir):
    t = T(spark, sf_dir)
    requests = _section_requests(t)
    # only the requested routes and dates are aggregated
    od = t.od().join(requests.select("service_date", "route_name").distinct(), ["service_date", "route_name"], "left_semi")
    out = cg.section_congestion(cg.congestion(od, t.loc()), requests)
    return out.withColumn("pos", F.col("pos").cast("int"))


# --------------------------------------------------------------------------
# K21 (every stop), K22
PLACE = """CAST(ROW_NUMBER() OVER (PARTITION BY service_date, route_name, ars{more}
  ORDER BY seq NULLS LAST, stop_name NULLS LAST) AS INTEGER) AS pos"""


def _k21_sql():
    return oracle_with("od") + f"""
SELECT *, {PLACE.format(more=', direction')} FROM (
  SELECT service_date, route_name, e.ars, e.stop_name, CAST(SUM(riders) AS BIGINT) AS riders,
         CAST(MIN(e.seq) AS INTEGER) AS seq, e.direction
  FROM (SELECT service_date, route_name, riders, unnest([
          {{'direction': 'destination', 'ars': board_ars, 'stop_name': alight_name, 'seq': alight_seq, 'far': alight_ars}},
          {{'direction': 'origin', 'ars': alight_ars, 'stop_name': board_name, 'seq': board_seq, 'far': board_ars}}]) AS e
        FROM od) u
  WHERE e.far <> {V} AND e.ars IS NOT NULL GROUP BY ALL) g"""


@register("od_for_stop", _k21_sql)
def od_for_stop(spark, sf_dir):
    return odo.od_for_stops(T(spark, sf_dir).od())


def _k22_sql(side):
    key, far = ("board", "alight") if side == "b" else ("alight", "board")
    return oracle_with("od") + f"""
SELECT *, {PLACE.format(more='')} FROM (
  SELECT service_date, route_name, {key}_ars AS ars, {far}_name AS stop_name, CAST(SUM(riders) AS BIGINT) AS riders,
         CAST(MIN({far}_seq) AS INTEGER) AS seq
  FROM od WHERE {V} NOT IN (board_ars, alight_ars) GROUP BY ALL) g"""


@register("od_all_boarding", lambda: _k22_sql("b"))
def od_all_boarding(spark, sf_dir):
    return odo.all_boarding(T(spark, sf_dir).od())


@register("od_all_alighting", lambda: _k22_sql("a"))
def od_all_alighting(spark, sf_dir):
    return odo.all_alighting(T(spark, sf_dir).od())


# --------------------------------------------------------------------------
# K23 .. K26
NET_CTE = f""",
mapped AS (SELECT * FROM cong WHERE lat IS NOT NULL AND lon IS NOT NULL),
net AS (
  SELECT m.*, d.network_max_load,
         CAST(CASE WHEN d.network_max_load > 0 THEN {O.pct1_sql('m.load', 'd.network_max_load')} ELSE 0.0 END AS DOUBLE)
           AS network_pct
  FROM mapped m JOIN (SELECT service_date, MAX(load) AS network_max_load FROM mapped GROUP BY service_date) d
    ON m.service_date = d.service_date)
"""


def _k25_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes() + NET_CTE + f"""
SELECT {O.CONG_COLS}, network_max_load, network_pct, {O.color_sql('network_pct')} AS network_color FROM net""")


@register("network_congestion", _k25_sql)
def network_congestion(spark, sf_dir):
    t = T(spark, sf_dir)
    return ly.network_congestion(cg.congestion(t.od(), t.loc()))


def _k23_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes() + NET_CTE + f""",
seq_net AS (
  SELECT n.*, row_number() OVER w AS pos, lead(stop_name) OVER w AS to_name,
         lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon
  FROM net n
  WINDOW w AS (PARTITION BY service_date, route_name
               ORDER BY seq ASC NULLS LAST, ars ASC NULLS LAST, stop_name ASC NULLS LAST))
SELECT service_date, route_name, CAST(pos AS INTEGER) AS pos, stop_name AS from_name, to_name,
       lat AS from_lat, lon AS from_lon, to_lat, to_lon, pct, grade, color, network_pct,
       {O.color_sql('network_pct')} AS network_color
FROM seq_net WHERE to_lat IS NOT NULL""")


@register("map_segments", _k23_sql)
def map_segments(spark, sf_dir):
    t = T(spark, sf_dir)
    return ly.segments(cg.congestion(t.od(), t.loc())).withColumn("pos", F.col("pos").cast("int"))


def _k24_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes() + NET_CTE + f""",
dest AS (
  SELECT service_date, route_name, ars,
         to_json(list(struct_pack(stop_name := stop_name, riders := riders)
                      ORDER BY seq ASC NULLS LAST, stop_name ASC NULLS FIRST)) AS destinations
  FROM (SELECT service_date, route_name, board_ars AS ars, alight_name AS stop_name,
               CAST(SUM(riders) AS BIGINT) AS riders, MIN(alight_seq) AS seq
        FROM od WHERE board_ars != {V} AND alight_ars != {V}
        GROUP BY service_date, route_name, board_ars, alight_name) x
  GROUP BY service_date, route_name, ars),
orig AS (
  SELECT service_date, route_name, ars,
         to_json(list(struct_pack(stop_name := stop_name, riders := riders)
                      ORDER BY seq ASC NULLS LAST, stop_name ASC NULLS FIRST)) AS origins
  FROM (SELECT service_date, route_name, alight_ars AS ars, board_name AS stop_name,
               CAST(SUM(riders) AS BIGINT) AS riders, MIN(board_seq) AS seq
        FROM od WHERE board_ars != {V} AND alight_ars != {V}
        GROUP BY service_date, route_name, alight_ars, board_name) x
  GROUP BY service_date, route_name, ars)
SELECT n.service_date, n.route_name, strftime(strptime(n.service_date, '%Y%m%d'), '%Y-%m-%d') AS date_label,
       n.seq, n.ars, n.stop_name, n.lat, n.lon, n.load, n.total_riders, n.pct, n.grade, n.color,
       CASE WHEN n.pct > 50 THEN 'white' ELSE 'black' END AS text_color,
       n.network_pct, {O.color_sql('n.network_pct')} AS network_color,
       CASE WHEN n.network_pct > 50 THEN 'white' ELSE 'black' END AS network_text_color,
       COALESCE(CAST(d.destinations AS VARCHAR), '[]') AS destinations,
       COALESCE(CAST(o.origins AS VARCHAR), '[]') AS origins
FROM net n
LEFT JOIN dest d ON d.service_date = n.service_date AND d.route_name = n.route_name AND d.ars = n.ars
LEFT JOIN orig o ON o.service_date = n.service_date AND o.route_name = n.route_name AND o.ars = n.ars""")


@register("map_markers", _k24_sql)
def map_markers(spark, sf_dir):
    t = T(spark, sf_dir)
    return ly.markers(cg.congestion(t.od(), t.loc()), t.od())


def _k26_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes() + f""",
dens AS (
  SELECT service_date, ars, stop_name, lat, lon, CAST(SUM(load) AS BIGINT) AS total_load
  FROM cong WHERE lat IS NOT NULL AND lon IS NOT NULL AND stop_name IS NOT NULL
  GROUP BY service_date, ars, stop_name, lat, lon),
dp AS (
  SELECT d.*, CAST(CASE WHEN m.mx > 0 THEN {O.pct1_sql('d.total_load', 'm.mx')} ELSE 0.0 END AS DOUBLE) AS density_pct
  FROM dens d JOIN (SELECT service_date, MAX(total_load) AS mx FROM dens GROUP BY service_date) m
    ON d.service_date = m.service_date)
SELECT service_date, ars, stop_name, lat, lon, total_load, density_pct,
       {O.color_sql('density_pct')} AS color,
       CAST(greatest(4, floor(density_pct / 8) + 4) AS INTEGER) AS radius
FROM dp""")


@register("stop_density", _k26_sql)
def stop_density(spark, sf_dir):
    t = T(spark, sf_dir)
    return ly.stop_density(cg.congestion(t.od(), t.loc()))


# --------------------------------------------------------------------------
# The stored congestion after one date of the OD store changed
CHANGED = "20241019"
LEFT = "CASE WHEN service_date = '{d}' THEN riders % 2 = 1 ELSE TRUE END"


def _reuse_sql():
    return (oracle_with("od", "loc") + "," + O.congestion_ctes(where=LEFT.format(d=CHANGED))
            + f"SELECT {O.CONG_COLS}, service_date = '{CHANGED}' AS recomputed FROM cong")


@register("congestion_reuse", _reuse_sql)
def congestion_reuse(spark, sf_dir):
    """Congestion is stored, one date of the source loses its rows with even riders,
    and the store is brought up to date: the rows then held, and which dates were computed again."""
    t = T(spark, sf_dir)
    od_path, cache = staged_path(spark, "reuse-od"), staged_path(spark, "reuse-congestion")
    io.write_od(t.od(), od_path)
    maps.refresh_congestion(spark, od_path, t.loc(), cache)
    io.write_od(t.od().where((F.col("service_date") == CHANGED) & (F.col("riders") % 2 == 1)), od_path, dates=[CHANGED])
    again = maps.refresh_congestion(spark, od_path, t.loc(), cache)
    return maps.read_congestion(spark, cache).withColumn("recomputed", F.col("service_date").isin(again))


# --------------------------------------------------------------------------
# S3: the dates of a request table prune the store's partitions at run time
@register("od_store_requests", lambda: oracle_with("od") + f"""
SELECT service_date, route_name, ars, CAST(SUM(riders) AS BIGINT) AS riders
FROM (SELECT service_date, route_name, board_ars AS ars, riders FROM od
      WHERE service_date IN (SELECT service_date FROM od GROUP BY service_date
                             HAVING SUM(riders) < 0.99 * (SELECT MAX(n) FROM (SELECT SUM(riders) AS n FROM od GROUP BY service_date) s)
                                 OR MIN(service_date) = (SELECT MIN(service_date) FROM od))) b
GROUP BY ALL""")
def od_store_requests(spark, sf_dir):
    """Riders per stop on the first date of the store and on those below 99 % of the busiest
    one: the dates stay a table, which prunes the store's partitions."""
    od = T(spark, sf_dir).od()
    path = staged_path(spark, "requests-od")
    io.write_od(od, path)
    days = od.groupBy("service_date").agg(F.sum("riders").alias("n"))
    top = days.agg(F.max("n").alias("top"), F.min("service_date").alias("first")).first()  # one row
    wanted = cut_lineage(days, "request-dates").where((F.col("n") < 0.99 * top.top) | (F.col("service_date") == top.first))
    return (io.read_od(spark, path, wanted).groupBy("service_date", "route_name", F.col("board_ars").alias("ars"))
            .agg(F.sum("riders").cast("long").alias("riders")))
