"""Registered enrichment queries (K1..K8, K2, M11, S10) and code lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from odspark.operators import correct as cr
from odspark.operators import enrich as en
from odspark.plans.registry import T, register
from odspark.sources import code_lookup as cl
from odspark.sources.fixtures import oracle_with

TGT_COLS = ["service_date", "route_name", "board_seq", "board_ars", "board_name", "alight_seq",
            "alight_ars", "alight_name", "riders"]
REF_COLS = ["route_id", "board_seq", "board_ars", "board_name", "alight_seq", "alight_ars",
            "alight_name"]
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _mode(src, key, val, out, where="TRUE"):
    keys = ", ".join(key)
    return f"""(SELECT {keys}, {val} AS {out} FROM (
      SELECT {keys}, {val}, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY COUNT(*) DESC, {val} ASC) AS rn
      FROM {src} WHERE {val} IS NOT NULL AND {where} GROUP BY {keys}, {val}) m WHERE rn = 1)"""


def _norm_ctes():
    tg = ", ".join(STRIP.format(x=f"replace({c}, '\"', '')") + f" AS {c}" for c in TGT_COLS)
    rf = ", ".join(STRIP.format(x=c) + f" AS {c}" for c in REF_COLS)
    return f""",
tg AS (SELECT *, TRY_CAST(board_seq AS DOUBLE) AS bsn, TRY_CAST(alight_seq AS DOUBLE) AS asn
       FROM (SELECT {tg} FROM target_day) x),
rf AS (SELECT *, TRY_CAST(board_seq AS DOUBLE) AS bsn, TRY_CAST(alight_seq AS DOUBLE) AS asn
       FROM (SELECT {rf} FROM ref_day) x),
tdist AS (SELECT DISTINCT route_name, board_name, bsn FROM tg),
rdist AS (SELECT DISTINCT route_id, board_name, bsn FROM rf)"""


def _vote_sql(by, other):
    return oracle_with("target_day", "ref_day") + _norm_ctes() + f""",
votes AS (SELECT t.route_name, r.route_id, COUNT(*) AS matches
  FROM tdist t JOIN rdist r ON t.board_name = r.board_name AND t.bsn = r.bsn
  WHERE t.route_name IS NOT NULL AND r.route_id IS NOT NULL GROUP BY t.route_name, r.route_id)
SELECT {by}, {other}, matches FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY matches DESC, {other} ASC) AS rn FROM votes) v
WHERE rn = 1"""


@register("route_vote", lambda: _vote_sql("route_name", "route_id"))
def route_vote(spark, sf_dir):
    t = T(spark, sf_dir)
    return en.route_vote(en.normalise_target(t.target_day()), en.normalise_reference(t.ref_day()))


@register("route_name_vote", lambda: _vote_sql("route_id", "route_name"))
def route_name_vote(spark, sf_dir):
    t = T(spark, sf_dir)
    return en.route_name_vote(en.normalise_target(t.target_day()), en.normalise_reference(t.ref_day()))


def _fill_cte(name, prev, key, code, dkey, dcode):
    donors = _mode(prev, [dkey], dcode, "v", where=f"{dkey} IS NOT NULL")
    cols = ", ".join(f"COALESCE(a.{code}, d.v) AS {code}" if col == code else f"a.{col}"
                     for col in ["service_date", "route_name", "route_id", "board_seq", "board_ars",
                                 "board_code", "board_name", "alight_seq", "alight_ars",
                                 "alight_code", "alight_name", "riders"])
    return f",\n{name} AS (SELECT {cols} FROM {prev} a LEFT JOIN {donors} d ON a.{key} = d.{dkey})"


def _enrich_sql(stages: int):
    sql = oracle_with("target_day", "ref_day") + _norm_ctes() + f""",
votes AS (SELECT t.route_name, r.route_id, COUNT(*) AS matches
  FROM tdist t JOIN rdist r ON t.board_name = r.board_name AND t.bsn = r.bsn
  WHERE t.route_name IS NOT NULL AND r.route_id IS NOT NULL GROUP BY t.route_name, r.route_id),
rm AS (SELECT route_name, route_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY route_name ORDER BY matches DESC, route_id ASC) AS rn FROM votes) v
  WHERE rn = 1),
bmap AS {_mode('rf', ['route_id', 'bsn'], 'board_ars', 'code', where='bsn IS NOT NULL')},
amap AS {_mode('rf', ['route_id', 'asn'], 'alight_ars', 'code', where='asn IS NOT NULL')},
p0 AS (
  SELECT t.service_date, t.route_name, rm.route_id, t.board_seq,
         CASE WHEN length(t.board_ars) < 5 THEN lpad(t.board_ars, 5, '0') ELSE t.board_ars END AS board_ars,
         bm.code AS board_code, t.board_name, t.alight_seq,
         CASE WHEN length(t.alight_ars) < 5 THEN lpad(t.alight_ars, 5, '0') ELSE t.alight_ars END AS alight_ars,
         am.code AS alight_code, t.alight_name, t.riders
  FROM tg t LEFT JOIN rm ON t.route_name = rm.route_name
  LEFT JOIN bmap bm ON bm.route_id = rm.route_id AND bm.bsn = t.bsn
  LEFT JOIN amap am ON am.route_id = rm.route_id AND am.asn = t.asn)"""
    sql += _fill_cte("p1b", "p0", "board_ars", "board_code", "board_ars", "board_code")
    sql += _fill_cte("p1", "p1b", "alight_ars", "alight_code", "alight_ars", "alight_code")
    last = "p1"
    if stages >= 2:
        sql += _fill_cte("p2b", "p1", "board_name", "board_code", "board_name", "board_code")
        sql += _fill_cte("p2", "p2b", "alight_name", "alight_code", "alight_name", "alight_code")
        last = "p2"
    if stages >= 3:
        sql += _fill_cte("p3a", "p2", "alight_ars", "alight_code", "board_ars", "board_code")
        sql += _fill_cte("p3", "p3a", "board_ars", "board_code", "alight_ars", "alight_code")
        last = "p3"
    return sql + f"\nSELECT * FROM {last}"


def _enrich_q(stages):
    def q(spark, sf_dir):
        t = T(spark, sf_dir)
        return en.enrich_od(t.target_day(), t.ref_day(), fill_stages=stages)
    return q


register("enrich_od", lambda: _enrich_sql(3))(_enrich_q(3))
register("enrich_od_stage1", lambda: _enrich_sql(1))(_enrich_q(1))
register("enrich_od_stage2", lambda: _enrich_sql(2))(_enrich_q(2))


@register("null_report", lambda: _enrich_sql(3).replace(
    "\nSELECT * FROM p3", """
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE route_id IS NULL) AS null_route_id,
       COUNT(*) FILTER (WHERE board_code IS NULL) AS null_board_code,
       COUNT(*) FILTER (WHERE alight_code IS NULL) AS null_alight_code FROM p3"""))
def null_report(spark, sf_dir):
    return en.null_report(_enrich_q(3)(spark, sf_dir))


# --------------------------------------------------------------------------
# S8 + K15: code lookup from JSON responses, applied as a batch update
LOOKUP_SQL = """lk AS (SELECT ars, json_extract_string(try_cast(body AS JSON), '$[0].sttnId') AS code FROM code_resp)"""


@register("code_lookup_json", lambda: oracle_with("code_resp") + "," + LOOKUP_SQL + "\nSELECT ars, code FROM lk")
def code_lookup_json(spark, sf_dir):
    return cl.parse_code_responses(T(spark, sf_dir).code_resp())


def _code_updates_sql():
    from odspark.constants import OD_COLUMNS
    cols = ", ".join("COALESCE(u.code, a.board_code) AS board_code" if c == "board_code" else f"a.{c}"
                     for c in OD_COLUMNS)
    return oracle_with("od", "code_resp") + "," + LOOKUP_SQL + f""",
upd AS (SELECT n.service_date, n.route_name, n.board_ars, n.alight_ars, MIN(lk.code) AS code
        FROM (SELECT DISTINCT service_date, route_name, board_ars, alight_ars FROM od WHERE board_code IS NULL) n
        JOIN lk ON lk.ars = n.board_ars WHERE lk.code IS NOT NULL
        GROUP BY n.service_date, n.route_name, n.board_ars, n.alight_ars)
SELECT {cols} FROM od a LEFT JOIN upd u ON a.service_date = u.service_date AND a.route_name = u.route_name
  AND a.board_ars = u.board_ars AND a.alight_ars = u.alight_ars"""


@register("code_updates", _code_updates_sql)
def code_updates(spark, sf_dir):
    """F3 -> S8 -> K15: keys with a NULL boarding code, codes looked up by
    their ARS, written back to every row of those keys."""
    t = T(spark, sf_dir)
    od = t.od()
    codes = cl.parse_code_responses(t.code_resp())
    keys = (od.where(F.col("board_code").isNull())
            .select("service_date", "route_name", "board_ars", "alight_ars").distinct())
    updates = keys.join(codes, keys["board_ars"] == codes["ars"]).drop("ars")
    return cr.apply_code_updates(od, updates, "board")
