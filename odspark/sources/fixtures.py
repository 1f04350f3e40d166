"""Portable fixture tables derived from the driver's TPC-H-like parquet files.

The domain tables (OD fact, stop locations, transactions, ...) do not exist
in the test data, so each one is a Spark SQL view over ``lineitem``,
``orders``, ``part``, ``supplier`` or ``nation`` (schemas in FIXTURES.md).
The same text runs unchanged in DuckDB, which is how the oracle gets
identical input rows: ``oracle_with(...)`` renders the views as CTEs.

In a session each view is materialised once as a parquet table under the
checkpoint directory (see ``Tables``), so queries start from a scan with
column pruning and filter pushdown, as they would on the stored tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from odspark.session import cut_lineage

# Fixture view texts; ``{name}`` marks an input table or an earlier view.
FIXTURE_SQL: dict[str, str] = {
    "od": """
WITH base AS (
  SELECT l_orderkey AS k,
         CASE WHEN l_orderkey % 3 = 0 THEN '20231017' WHEN l_orderkey % 3 = 1 THEN '20241019' ELSE '20251014' END AS service_date,
         CAST(l_suppkey % 10 AS INT) AS r,
         CAST(CASE WHEN l_suppkey % 10 = 0 THEN 120 ELSE 30 END AS INT) AS n,
         l_partkey AS p, CAST(l_quantity AS INT) AS riders
  FROM {lineitem}),
s AS (SELECT *, CAST(p % n AS INT) + 1 AS b, CAST(least(p % n + 1 + k % 9, n) AS INT) AS a FROM base)
SELECT service_date,
  concat('R', CAST(r AS VARCHAR(10))) AS route_name,
  CASE WHEN k % 47 = 0 THEN NULL ELSE CAST(100000 + r AS BIGINT) END AS route_id,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 83 = 0 THEN 0 WHEN k % 61 = 0 THEN b + 1 ELSE b END AS board_seq,
  CASE WHEN k % 73 = 0 THEN NULL WHEN k % 79 = 0 THEN '06137' WHEN k % 83 = 0 THEN '00000'
       ELSE lpad(CAST(r * 1000 + b AS VARCHAR(10)), 5, '0') END AS board_ars,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(100000000 + r * 1000 + b AS VARCHAR(12)) END AS board_code,
  CASE WHEN k % 53 = 0 OR k % 83 = 0 THEN concat('기점가상', CAST(r AS VARCHAR(10)))
       WHEN k % 71 = 0 THEN concat('경유', CAST(r AS VARCHAR(10)))
       WHEN k % 79 = 0 THEN '가상06137'
       ELSE concat('S', CAST(r * 1000 + b AS VARCHAR(10))) END AS board_name,
  CASE WHEN k % 59 = 0 THEN NULL WHEN k % 67 = 0 THEN a + 2 ELSE a END AS alight_seq,
  CASE WHEN k % 118 = 0 THEN '00000' ELSE lpad(CAST(r * 1000 + a AS VARCHAR(10)), 5, '0') END AS alight_ars,
  CASE WHEN k % 118 = 0 THEN '277102436' WHEN k % 43 = 0 THEN NULL
       ELSE CAST(100000000 + r * 1000 + a AS VARCHAR(12)) END AS alight_code,
  CASE WHEN k % 118 = 0 THEN '' WHEN k % 59 = 0 OR k % 89 = 0 THEN concat('종점가상', CAST(r AS VARCHAR(10)))
       ELSE concat('S', CAST(r * 1000 + a AS VARCHAR(10))) END AS alight_name,
  riders
FROM s
""",
    "loc": """
SELECT concat('''', ars) AS stop_no, concat('''', nm) AS stop_name,
  CAST(CASE WHEN x % 29 = 0 THEN 35.1 ELSE 37.4 + r * 0.01 + x * 0.001 END AS DOUBLE) AS lat,
  CAST(126.9 + r * 0.01 + x * 0.002 AS DOUBLE) AS lon
FROM (SELECT DISTINCT CAST(l_suppkey % 10 AS INT) AS r,
  CAST(l_partkey % CASE WHEN l_suppkey % 10 = 0 THEN 120 ELSE 30 END AS INT) + 1 AS x,
  lpad(CAST((l_suppkey % 10) * 1000 + l_partkey % CASE WHEN l_suppkey % 10 = 0 THEN 120 ELSE 30 END + 1 AS VARCHAR(10)), 5, '0') AS ars,
  concat('S', CAST((l_suppkey % 10) * 1000 + l_partkey % CASE WHEN l_suppkey % 10 = 0 THEN 120 ELSE 30 END + 1 AS VARCHAR(10))) AS nm
  FROM {lineitem}) t
""",
    "tx": """
SELECT CAST(l_suppkey AS BIGINT) AS route_id, l_partkey AS board_stop_id,
  (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM {part}) AS alight_stop_id,
  o_orderdate + INTERVAL '1' HOUR * CAST((l_partkey + l_linenumber) % 24 AS INT) AS board_ts,
  CAST(l_quantity AS INT) AS riders, l_linenumber % 4 AS transfer_cnt, l_returnflag AS user_type,
  CAST(floor(l_extendedprice / 4) AS INT) AS distance_m, CAST(floor(l_extendedprice / 20) AS INT) AS ride_sec
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
""",
    "routes": """
SELECT s_suppkey AS route_id, concat('R', CAST(s_suppkey % 10 AS VARCHAR(10))) AS route_name FROM {supplier}
""",
    "stops": """
SELECT p_partkey AS stop_id, concat('P', CAST(p_partkey AS VARCHAR(10))) AS stop_name,
  concat('R', CAST(p_partkey % 10 AS VARCHAR(10))) AS route_name, CAST(p_partkey % 60 AS INT) + 1 AS stop_seq FROM {part}
""",
    "ref_day": """
SELECT CAST(100000 + CAST(substring(route_name, 2, 2) AS INT) AS VARCHAR(10)) AS route_id,
  CAST(board_seq AS VARCHAR(10)) AS board_seq,
  CAST(100000000 + CAST(substring(route_name, 2, 2) AS INT) * 1000 + coalesce(board_seq, 0) AS VARCHAR(12)) AS board_ars,
  concat(' ', board_name) AS board_name, CAST(alight_seq AS VARCHAR(10)) AS alight_seq,
  CAST(100000000 + CAST(substring(route_name, 2, 2) AS INT) * 1000 + coalesce(alight_seq, 0) AS VARCHAR(12)) AS alight_ars,
  alight_name
FROM {od} WHERE service_date = '20241019'
""",
    "target_day": """
SELECT service_date, concat('"', route_name, '"') AS route_name, CAST(board_seq AS VARCHAR(10)) AS board_seq,
  CAST(CAST(board_ars AS INT) AS VARCHAR(10)) AS board_ars, board_name,
  CASE WHEN alight_seq % 13 = 0 THEN 'x' ELSE CAST(alight_seq AS VARCHAR(10)) END AS alight_seq,
  CAST(CAST(alight_ars AS INT) AS VARCHAR(10)) AS alight_ars, concat(alight_name, ' ') AS alight_name,
  CAST(riders AS VARCHAR(10)) AS riders
FROM {od} WHERE service_date = '20251014'
""",
    "code_resp": """
SELECT DISTINCT board_ars AS ars, CASE WHEN board_ars LIKE '%7' THEN '[]' WHEN board_ars LIKE '%9' THEN 'oops'
  ELSE concat('[{"sttnId":"1', board_ars, '000"},{"sttnId":"zzz"}]') END AS body
FROM {od} WHERE board_ars IS NOT NULL
""",
    "daily_od": """
SELECT CAST(o_orderdate AS DATE) AS day, concat('R', CAST(l_suppkey % 10 AS VARCHAR(10))) AS route_name,
  CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS riders
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2
""",
    "daily_stop": """
SELECT route_name, stop_id, direction, day, CAST(sum(riders) AS BIGINT) AS riders
FROM (SELECT route_id, board_stop_id AS stop_id, 'board' AS direction, CAST(board_ts AS DATE) AS day, riders FROM {tx}
      UNION ALL
      SELECT route_id, alight_stop_id, 'alight', CAST(board_ts AS DATE), riders FROM {tx}) e
JOIN {routes} r ON e.route_id = r.route_id GROUP BY 1, 2, 3, 4
""",
    "holiday": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}
WHERE day(o_orderdate) = 1 OR (month(o_orderdate) = 12 AND day(o_orderdate) = 25)
""",
    "hour_weight": """
SELECT dt AS day_type, CAST(hr AS INT) AS hour, CAST(1 + (hr % 5) * 0.25 + ver * 0.1 AS DOUBLE) AS weight, CAST(ver AS INT) AS ver
FROM (SELECT DISTINCT n_nationkey % 24 AS hr FROM {nation}) h
CROSS JOIN (VALUES ('weekday'), ('saturday'), ('sunday'), ('holiday')) d(dt) CROSS JOIN (VALUES (1), (2)) v(ver)
""",
}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named fixture views (and the views they
    read) for the DuckDB oracle, where driver tables are pre-registered."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in DRIVER_TABLES:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        body = _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[n]).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


def _spread(df: DataFrame) -> DataFrame:
    """A scan of files too small to occupy the cores is dealt anew, by size, so that
    later scans are not one task; a larger one has splits enough without a shuffle."""
    try:
        few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        few = True
    return df.hint("rebalance") if few else df


class Tables:
    """Fixture DataFrames for one scale-factor directory.

    Each view is materialised once (a written table in the session's shared
    staging folder), the way the domain tables are stored tables in
    production: downstream plans then start from a scan instead of
    re-deriving the view inside every step.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[key]

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            args = {d: (self.raw(d) if d in DRIVER_TABLES else self.view(d)) for d in _deps(name)}
            # spark.sql formats its text: escape literal braces (JSON), keep placeholders
            text = FIXTURE_SQL[name].replace("{", "{{").replace("}", "}}")
            text = re.sub(r"\{\{(\w+)\}\}", r"{\1}", text)
            df = self.spark.sql(text, **args)
            if self.materialize:
                # the other views come from spread files or from a shuffle and are
                # written as they lie
                if name == "od":
                    df = _spread(df)
                df = cut_lineage(df, name)
            self._cache[name] = df
        return self._cache[name]

    # convenience accessors
    def od(self) -> DataFrame:
        return self.view("od")

    def loc(self) -> DataFrame:
        return self.view("loc")

    def tx(self) -> DataFrame:
        return self.view("tx")

    def routes(self) -> DataFrame:
        return self.view("routes")

    def stops(self) -> DataFrame:
        return self.view("stops")

    def ref_day(self) -> DataFrame:
        return self.view("ref_day")

    def target_day(self) -> DataFrame:
        return self.view("target_day")

    def code_resp(self) -> DataFrame:
        return self.view("code_resp")

    def daily_od(self) -> DataFrame:
        return self.view("daily_od")

    def daily_stop(self) -> DataFrame:
        return self.view("daily_stop")

    def holiday(self) -> DataFrame:
        return self.view("holiday")

    def hour_weight(self) -> DataFrame:
        return self.view("hour_weight")
