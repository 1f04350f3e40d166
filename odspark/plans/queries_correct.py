"""Registered correction queries (each step, each group, the whole chain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from odspark.constants import FIRST_FILL_YEAR_PREFIX, OD_COLUMNS
from odspark.operators import correct as cr
from odspark.operators import lookup as lk
from odspark.plans import oracle_correct as OC
from odspark.plans.pipeline import run_snapshot
from odspark.plans.registry import T, register
from odspark.functions.text import missing_to_null, to_number
from odspark.session import cut_lineage, staged_path
from odspark.sources import io
from odspark.sources.fixtures import oracle_with
from odspark.sources.snapshots import Snapshots

# prefixes of group 1: each step seen on the data it meets in the chain
_G1 = {
    "fix_c1_virtual_boarding_ars": ("c1", 1),
    "fix_c2_virtual_alighting_ars": ("c2", 2),
    "fix_c4_origin_virtual_seq": ("c4", 3),
    "fix_c6_empty_terminal_name": ("c6", 8),
    "fix_c7_virtual_alighting_to_self": ("c7", 9),
    "fix_c8_mid_virtual_boarding": ("c8", 10),
    "fix_c9_virtual_same_od": ("c9", 11),
}


def _g1_query(upto):
    def q(spark, sf_dir):
        df = cr.group1_tagged(T(spark, sf_dir).od(), upto=upto)
        return cr.od_only(df.where(~F.col("t_c5c2")) if "t_c5c2" in df.columns else df)
    return q


for _name, (_upto, _n) in _G1.items():
    register(_name, (lambda n=_n: OC.chain(OC.GROUP1[:n])))(_g1_query(_upto))


@register("fix_c5_terminal_virtual_seq", lambda: OC.chain(OC.GROUP1[:7]))
def fix_c5(spark, sf_dir):
    df = cr.group1_tagged(T(spark, sf_dir).od(), upto="c5")
    return cr.od_only(df.where(~F.col("t_c5c2")))


@register("anomaly_rows", lambda: OC.chain(OC.GROUP1[:5] + [OC.step_c5c2_anomalies]))
def anomaly_rows(spark, sf_dir):
    return cr.anomaly_rows(T(spark, sf_dir).od())


@register("fix_virtual_stop", lambda: OC.chain(OC.GROUP1 + [OC.step_dedup]))
def fix_virtual_stop(spark, sf_dir):
    return cr.fix_virtual_stop(T(spark, sf_dir).od())


_G1_COUNT_TAGS = ["t_c1", "t_c2", "t_c4", "t_c5a", "t_c5c1", "t_c5c2", "t_c5b", "t_c6", "t_c7",
                  "t_c8", "t_c9"]


@register("virtual_stop_counts", OC.step_counts_sql)
def virtual_stop_counts(spark, sf_dir):
    """Affected rows per group-1 step and date (one aggregate over the tags)."""
    df = cr.group1_tagged(T(spark, sf_dir).od())
    return df.groupBy("service_date").agg(
        *[F.count_if(F.col(t)).alias(t[2:]) for t in _G1_COUNT_TAGS])


@register("sequence_same_stop_counts", OC.group23_counts_sql)
def sequence_same_stop_counts(spark, sf_dir):
    """Affected rows per date of the group-2 steps (K10, K11) and group-3
    steps (K12a, K12b), each group run on the stored table."""
    od = T(spark, sf_dir).od()
    g2 = cr.sequence_fixes(od).groupBy("service_date").agg(
        F.count_if(F.col("t_k10")).alias("k10"), F.count_if(F.col("t_k11")).alias("k11"))
    g3 = cr.k12b_same_stop_by_ars(cr.k12a_same_stop_by_seq(od)).groupBy("service_date").agg(
        F.count_if(F.col("t_k12a")).alias("k12a"), F.count_if(F.col("t_k12b")).alias("k12b"))
    return g2.join(g3, "service_date", "full")


def _residual_sql():
    from odspark.plans.oracle import EXEMPT, TERMINAL, V, vname_sql
    final = f"""
SELECT service_date,
  COUNT(*) FILTER (WHERE {vname_sql('board_name')}
                   AND board_ars != {V} AND board_ars != {EXEMPT}) AS unfixed_virtual_board_ars,
  COUNT(*) FILTER (WHERE {vname_sql('alight_name')}
                   AND alight_ars != {V} AND alight_ars != {EXEMPT}) AS unfixed_virtual_alight_ars,
  COUNT(*) FILTER (WHERE board_ars = {V} AND board_seq IS NULL) AS null_board_seq,
  COUNT(*) FILTER (WHERE alight_ars = {V} AND alight_seq IS NULL) AS null_alight_seq,
  COUNT(*) FILTER (WHERE (alight_name IS NULL OR alight_name = '') AND alight_code = {TERMINAL}) AS empty_terminal_name
FROM {{p}} GROUP BY service_date"""
    return OC.chain(OC.GROUP1 + [OC.step_dedup], final=final)


@register("residual_counts", _residual_sql)
def residual_counts(spark, sf_dir):
    return cr.residual_counts(cr.fix_virtual_stop(T(spark, sf_dir).od()))


def _bidir_sql():
    from odspark.constants import BIDIRECTIONAL_MAX_SEQ
    from odspark.plans.oracle import V
    return oracle_with("od") + f""",
real_max AS (SELECT service_date, route_name, MAX(board_seq) AS m FROM od
             WHERE board_seq IS NOT NULL AND board_ars <> {V} GROUP BY service_date, route_name),
virtual_origin AS (SELECT DISTINCT service_date, route_name FROM od WHERE board_seq = 0 AND board_ars = {V})
SELECT v.service_date, v.route_name FROM virtual_origin v
JOIN real_max x ON x.service_date = v.service_date AND x.route_name = v.route_name
WHERE x.m > {BIDIRECTIONAL_MAX_SEQ}"""


@register("detect_bidirectional", _bidir_sql)
def detect_bidirectional(spark, sf_dir):
    return cr.detect_bidirectional(T(spark, sf_dir).od())


# group 2 and 3 as standalone endpoints on the stored table
@register("fix_k10_seq_by_mode", lambda: OC.chain([OC.step_k10]))
def fix_k10(spark, sf_dir):
    return cr.od_only(cr.k10_seq_by_mode(T(spark, sf_dir).od()))


@register("fix_k11_alight_seq_spread", lambda: OC.chain([OC.step_k10, OC.step_k11]))
def fix_k11(spark, sf_dir):
    return cr.od_only(cr.sequence_fixes(T(spark, sf_dir).od()))


@register("fix_sequence", lambda: OC.chain(OC.GROUP2 + [OC.step_dedup]))
def fix_sequence(spark, sf_dir):
    return cr.fix_sequence(T(spark, sf_dir).od())


@register("fix_k12a_same_stop_by_seq", lambda: OC.chain([OC.step_k12a]))
def fix_k12a(spark, sf_dir):
    return cr.od_only(cr.k12a_same_stop_by_seq(T(spark, sf_dir).od()))


@register("fix_k12b_same_stop_by_ars", lambda: OC.chain([OC.step_k12a, OC.step_k12b]))
def fix_k12b(spark, sf_dir):
    return cr.od_only(cr.k12b_same_stop_by_ars(cr.k12a_same_stop_by_seq(T(spark, sf_dir).od())))


@register("fix_same_stop_od", lambda: OC.chain(OC.GROUP3 + [OC.step_dedup]))
def fix_same_stop_od(spark, sf_dir):
    return cr.fix_same_stop_od(T(spark, sf_dir).od())


@register("dedup_sum", lambda: OC.chain([OC.step_dedup]))
def dedup_sum(spark, sf_dir):
    return cr.dedup_sum(T(spark, sf_dir).od())


def _dup_groups_sql():
    return oracle_with("od") + """
SELECT service_date, CAST(COUNT(*) AS BIGINT) AS duplicate_groups FROM (
  SELECT service_date FROM od
  GROUP BY service_date, route_name, route_id, board_seq, board_ars, board_name, alight_seq, alight_ars, alight_name
  HAVING COUNT(*) > 1) t GROUP BY service_date"""


@register("duplicate_groups", _dup_groups_sql)
def duplicate_groups(spark, sf_dir):
    return cr.duplicate_groups(T(spark, sf_dir).od())


@register("correct_pipeline",
          lambda: OC.chain(OC.GROUP1 + [OC.step_dedup] + OC.GROUP2 + [OC.step_dedup]
                           + OC.GROUP3 + [OC.step_dedup]))
def correct_pipeline(spark, sf_dir):
    return cr.correct_pipeline(T(spark, sf_dir).od(), cut=cut_lineage)


def _rerun_sql():
    final = OC.chain(OC.GROUP1 + [OC.step_dedup] + OC.GROUP2 + [OC.step_dedup] + OC.GROUP3 + [OC.step_dedup])
    taken = OC.chain(OC.GROUP1[:5] + [OC.step_c5c2_anomalies])
    per_date = "SELECT service_date, COUNT(*) AS n, SUM(riders) AS riders FROM {t} GROUP BY service_date"
    return f"""WITH f AS ({per_date.format(t=f"({final})")}), a AS ({per_date.format(t=f"({taken})")}),
raw AS ({oracle_with("od")} {per_date.format(t="od")})
SELECT service_date, CAST(raw.riders AS BIGINT) AS riders_in, CAST(COALESCE(f.riders, 0) AS BIGINT) AS riders_final,
  CAST(COALESCE(a.riders, 0) AS BIGINT) AS riders_anomalies, COALESCE(f.n, 0) AS rows_final, COALESCE(a.n, 0) AS rows_anomalies
FROM raw LEFT JOIN f USING (service_date) LEFT JOIN a USING (service_date)"""


@register("nightly_rerun", _rerun_sql)
def nightly_rerun(spark, sf_dir):
    """The nightly job twice over one snapshot store: what each date holds after the second run."""
    od = T(spark, sf_dir).od()
    dates = [r[0] for r in od.select("service_date").distinct().collect()]  # the dates of the run
    store = Snapshots(spark, staged_path(spark, "nightly-store"))
    run_snapshot(store, dates, source=od)
    run_snapshot(store, dates)
    held = [store.read(t).groupBy("service_date").agg(F.sum("riders").cast("long").alias(f"riders_{n}"),
                                                      F.count("*").alias(f"rows_{n}"))
            for t, n in (("input", "in"), ("od", "final"), ("anomalies", "anomalies"))]
    out = held[0].join(held[1], "service_date", "left").join(held[2], "service_date", "left").na.fill(0)
    return out.select("service_date", "riders_in", "riders_final", "riders_anomalies", "rows_final", "rows_anomalies")


# --------------------------------------------------------------------------
# NULL codes from other dates
def _fill_sql(end):
    ars, code = f"{end}_ars", f"{end}_code"
    cols = ", ".join(f"COALESCE(a.{code}, s1.code, s2.code) AS {code}" if col == code else f"a.{col}"
                     for col in OD_COLUMNS)
    return oracle_with("od") + f""",
s1 AS (SELECT ars, code FROM (
  SELECT {ars} AS ars, {code} AS code,
         ROW_NUMBER() OVER (PARTITION BY {ars} ORDER BY COUNT(*) DESC, {code} ASC) AS rn
  FROM od WHERE service_date LIKE '{FIRST_FILL_YEAR_PREFIX}%' AND {code} IS NOT NULL AND {ars} IS NOT NULL
  GROUP BY {ars}, {code}) r WHERE rn = 1),
tgt AS (SELECT DISTINCT service_date, {ars} AS ars FROM od WHERE {code} IS NULL AND {ars} IS NOT NULL),
s2 AS (SELECT service_date, ars, code FROM (
  SELECT t.service_date, t.ars, b.{code} AS code,
         ROW_NUMBER() OVER (PARTITION BY t.service_date, t.ars ORDER BY COUNT(*) DESC, b.{code} ASC) AS rn
  FROM tgt t JOIN od b ON b.{ars} = t.ars AND b.service_date != t.service_date AND b.{code} IS NOT NULL
  GROUP BY t.service_date, t.ars, b.{code}) r WHERE rn = 1)
SELECT {cols}
FROM od a LEFT JOIN s1 ON s1.ars = a.{ars}
LEFT JOIN s2 ON s2.service_date = a.service_date AND s2.ars = a.{ars}"""


@register("fill_null_codes_board", lambda: _fill_sql("board"))
def fill_null_codes_board(spark, sf_dir):
    return cr.fill_null_codes(T(spark, sf_dir).od(), "board")


@register("fill_null_codes_alight", lambda: _fill_sql("alight"))
def fill_null_codes_alight(spark, sf_dir):
    return cr.fill_null_codes(T(spark, sf_dir).od(), "alight")


# --------------------------------------------------------------------------
# F3..F6 lookups
@register("null_board_codes", lambda: oracle_with("od") + "SELECT * FROM od WHERE board_code IS NULL")
def null_board_codes(spark, sf_dir):
    return lk.null_codes(T(spark, sf_dir).od(), "board")


@register("null_alight_codes", lambda: oracle_with("od") + "SELECT * FROM od WHERE alight_code IS NULL")
def null_alight_codes(spark, sf_dir):
    return lk.null_codes(T(spark, sf_dir).od(), "alight")


# F5 / F6 in batch form: the request table holds every key present in the data
# the looked-up keys come from the data: busy boarding stops, and routes with far stops
BUSY_RIDERS, FAR_SEQ = 200, 100


@register("by_board_ars", lambda: oracle_with("od") + f"""
SELECT * FROM od SEMI JOIN (
  SELECT board_ars FROM od GROUP BY board_ars HAVING SUM(riders) > {BUSY_RIDERS}) busy USING (board_ars)""")
def by_board_ars(spark, sf_dir):
    od = T(spark, sf_dir).od()
    busy = od.groupBy("board_ars").agg(F.sum("riders").alias("n")).where(F.col("n") > BUSY_RIDERS)
    return lk.by_board_ars(od, busy.select("board_ars"))


@register("by_route", lambda: oracle_with("od") + f"""
SELECT * FROM od SEMI JOIN (SELECT DISTINCT route_name FROM od WHERE board_seq > {FAR_SEQ}) far USING (route_name)""")
def by_route(spark, sf_dir):
    od = T(spark, sf_dir).od()
    return lk.by_route(od, od.where(F.col("board_seq") > FAR_SEQ).select("route_name"))


# --------------------------------------------------------------------------
# The date-partitioned store, written and read back for two dates
STORE_DATES = ["20231017", "20251014"]


@register("od_store_dates", lambda: oracle_with("od")
          + f"SELECT * FROM od WHERE service_date IN ('{STORE_DATES[0]}', '{STORE_DATES[1]}')")
def od_store_dates(spark, sf_dir):
    path = staged_path(spark, "od-store")
    io.write_od(T(spark, sf_dir).od(), path)
    return io.read_od(spark, path, STORE_DATES)


# --------------------------------------------------------------------------
# Text as raw files hold it; missing tokens and strict numbers
def _raw_text(col: str) -> str:
    return f"""CASE l_orderkey % 9 WHEN 0 THEN 'NULL' WHEN 1 THEN 'nan' WHEN 2 THEN concat({col}, 'd') WHEN 3 THEN ''
  WHEN 4 THEN concat(' ', {col}, ' ') WHEN 5 THEN concat({col}, 'e2') WHEN 6 THEN concat('-', {col}, '.50')
  WHEN 7 THEN 'Infinity' ELSE {col} END"""


RAW_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, {_raw_text('CAST(l_partkey AS VARCHAR(12))')} AS raw FROM lineitem"""


@register("raw_text_numbers", lambda: f"""
SELECT l_orderkey, l_linenumber, CASE WHEN raw NOT IN ('', 'NULL', 'nan') THEN raw END AS kept,
       CASE l_orderkey % 9 WHEN 4 THEN l_partkey WHEN 5 THEN l_partkey * 100.0 WHEN 6 THEN -l_partkey - 0.5
         WHEN 8 THEN l_partkey END AS number
FROM ({RAW_SQL}) r""".replace(" END AS number", " END::DOUBLE AS number"))
def raw_text_numbers(spark, sf_dir):
    raw = spark.sql(RAW_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=T(spark, sf_dir).raw("lineitem"))
    return raw.select("l_orderkey", "l_linenumber", missing_to_null("raw").alias("kept"), to_number("raw").alias("number"))


# --------------------------------------------------------------------------
# Pipe-separated files written and read back, broken lines kept apart
def _line(cols, mark="''"):
    return "concat_ws('|', " + ", ".join(f"COALESCE(NULLIF(CAST({n} AS VARCHAR(100)), ''), {mark})" for n in cols) + ")"


BROKEN_LINE = f"""CASE WHEN riders % 10 = 3 THEN {_line(OD_COLUMNS[:-2])}
  WHEN riders % 10 = 7 THEN concat({_line(OD_COLUMNS)}, '|x') END"""


@register("csv_round_trip", lambda: oracle_with("od") + f"""
SELECT CASE WHEN broken IS NULL THEN 'row' ELSE 'bad' END AS kind, COALESCE(broken, fields) AS line, COUNT(*) AS n
FROM (SELECT {BROKEN_LINE} AS broken, {_line(OD_COLUMNS, "'-'")} AS fields FROM od) l GROUP BY ALL""")
def csv_round_trip(spark, sf_dir):
    """The OD table as pipe-separated files, a fifth of its lines broken (fields missing or too
    many): every row as read back (``-`` for NULL) and every line set aside, with their counts."""
    od = T(spark, sf_dir).od().withColumn("_broken", F.expr(BROKEN_LINE))
    good, bad = staged_path(spark, "csv-good"), staged_path(spark, "csv-bad")
    io.write_csv(od.where(F.col("_broken").isNull()).select(*OD_COLUMNS), good, header=False)
    od.where(F.col("_broken").isNotNull()).select("_broken").write.text(bad)
    back, broken = io.read_checked_csv(spark, [good, bad], OD_COLUMNS, sep="|", header=False)
    rows = back.select(F.lit("row").alias("kind"), F.expr(_line(OD_COLUMNS, "'-'")).alias("line"))
    lines = broken.select(F.lit("bad").alias("kind"), F.col(io.BAD_LINE).alias("line"))
    return rows.unionByName(lines).groupBy("kind", "line").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------
# J20..J22: batch restores from masters derived from the data
from odspark.operators import restore as rs  # noqa: E402
from odspark.plans.oracle import LOCS_CTE  # noqa: E402


def _restore_sql(by_name: bool, bbox: bool):
    key = "ars, stop_name" if by_name else "ars"
    cond = "a.board_ars = m.ars" + (" AND a.board_name = m.stop_name" if by_name else "")
    from odspark.plans.oracle import BBOX
    box = f"AND {BBOX}" if bbox else ""
    cols = ", ".join("COALESCE(a.board_code, m.code) AS board_code" if c == "board_code" else f"a.{c}"
                     for c in OD_COLUMNS)
    return oracle_with("od", "loc") + f""",
{LOCS_CTE},
codes AS (SELECT ars, stop_name, code FROM (
  SELECT board_ars AS ars, board_name AS stop_name, board_code AS code,
         ROW_NUMBER() OVER (PARTITION BY board_ars, board_name ORDER BY COUNT(*) DESC, board_code ASC) AS rn
  FROM od WHERE board_code IS NOT NULL GROUP BY board_ars, board_name, board_code) r WHERE rn = 1),
master AS (SELECT c.ars, c.stop_name, c.code, l.lat, l.lon FROM codes c
           LEFT JOIN locs l ON l.ars = c.ars AND l.stop_name = c.stop_name),
m AS (SELECT {key}, code FROM (
  SELECT {key}, code, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY COUNT(*) DESC, code ASC) AS rn
  FROM master WHERE code IS NOT NULL {box} GROUP BY {key}, code) r WHERE rn = 1)
SELECT {cols} FROM od a LEFT JOIN m ON {cond}"""


@register("restore_codes_master", lambda: _restore_sql(True, True))
def restore_codes_master(spark, sf_dir):
    """NULL boarding codes restored on (ARS, stop name) from located stops."""
    t = T(spark, sf_dir)
    od = t.od()
    return rs.restore_codes(od, rs.station_master(od, t.loc()), "board", by_name=True, bbox=True)


@register("restore_codes_ars", lambda: _restore_sql(False, False))
def restore_codes_ars(spark, sf_dir):
    """NULL boarding codes restored from the station master on ARS only."""
    t = T(spark, sf_dir)
    od = t.od()
    return rs.restore_codes(od, rs.station_master(od, t.loc()), "board", by_name=False, bbox=False)


def _route_ids_sql():
    cols = ", ".join("COALESCE(a.route_id, m.route_id) AS route_id" if c == "route_id" else f"a.{c}"
                     for c in OD_COLUMNS)
    return oracle_with("od") + f""",
m AS (SELECT route_name, route_id FROM (
  SELECT route_name, route_id, ROW_NUMBER() OVER (PARTITION BY route_name ORDER BY COUNT(*) DESC, route_id ASC) AS rn
  FROM od WHERE route_id IS NOT NULL AND route_name IS NOT NULL GROUP BY route_name, route_id) r WHERE rn = 1)
SELECT {cols} FROM od a LEFT JOIN m ON a.route_name = m.route_name"""


@register("restore_route_ids", _route_ids_sql)
def restore_route_ids(spark, sf_dir):
    """NULL route ids restored from a route map (name -> id)."""
    od = T(spark, sf_dir).od()
    return rs.restore_route_ids(od, rs.route_map(od))
