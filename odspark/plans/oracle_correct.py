"""DuckDB formulations of the correction rules.

Every rule is stated over whole rows: a row-local rule is a CASE per column it
sets; a rule that looks at other rows first puts what it needs beside each row
(a route's last seq, the most frequent seq, the range of seqs of a pair) and
then decides row by row. Each step is one CTE over the one before it.
"""

from __future__ import annotations

from odspark.constants import (CASE_C1_SEQ_RANGE, CASE_C2_MAX_PCT, CASE_C2_MIN_SEQ, OD_COLUMNS,
                               SEQ_SPREAD_MAX)
from odspark.plans.oracle import EXEMPT, TERMINAL, V, vname_sql
from odspark.sources.fixtures import oracle_with


B4 = ["board_seq", "board_ars", "board_code", "board_name"]
A4 = ["alight_seq", "alight_ars", "alight_code", "alight_name"]


def _upd(prev: str, pred: str, sets: dict, src: str | None = None) -> str:
    cols = []
    for col in OD_COLUMNS:
        if col in sets:
            cols.append(f"CASE WHEN COALESCE({pred}, FALSE) THEN {sets[col]} ELSE a.{col} END AS {col}")
        else:
            cols.append(f"a.{col}")
    return f"SELECT {', '.join(cols)} FROM {src or prev + ' a'}"


# a route's last boarding seq of the day, beside every row
LAST = "(SELECT *, MAX(board_seq) OVER (PARTITION BY service_date, route_name) AS last_seq FROM {p})"
NO_ALIGHT_SEQ = f"alight_ars = {V} AND alight_seq IS NULL"
TOO_EARLY = (f"({NO_ALIGHT_SEQ} AND board_seq >= {CASE_C2_MIN_SEQ} "
             f"AND 100 * board_seq < {CASE_C2_MAX_PCT} * last_seq)")


# predicates of the row-local steps, over alias ``a`` of the step's input
PRED = {
    "c1": vname_sql("a.board_name") + f" AND (a.board_ars != {EXEMPT} OR a.board_ars IS NULL)",
    "c2": vname_sql("a.alight_name") + f" AND (a.alight_ars != {EXEMPT} OR a.alight_ars IS NULL)",
    "c4": f"a.board_ars = {V} AND a.board_seq IS NULL",
    "c5a": f"a.board_seq = 0 AND a.board_ars = {V} AND a.alight_ars = {V} AND a.alight_seq IS NULL",
    "c5c1": (f"a.alight_ars = {V} AND a.alight_seq IS NULL "
             f"AND a.board_seq BETWEEN {CASE_C1_SEQ_RANGE[0]} AND {CASE_C1_SEQ_RANGE[1]}"),
    "c6": f"(a.alight_name IS NULL OR a.alight_name = '') AND a.alight_code = {TERMINAL}",
    "c7": f"a.board_ars != {V} AND a.alight_ars = {V} AND a.alight_seq IS NOT NULL",
    "c8": f"a.board_ars = {V} AND a.board_seq != 0",
    "c9": f"a.board_ars = {V} AND a.alight_ars = {V} AND a.board_seq = a.alight_seq",
}


def step_c1(p):
    return _upd(p, PRED["c1"], {"board_ars": V})


def step_c2(p):
    return _upd(p, PRED["c2"], {"alight_ars": V})


def step_c4(p):
    return _upd(p, PRED["c4"], {"board_seq": "0"})


def step_c5a(p):
    return _upd(p, PRED["c5a"], {"alight_seq": "0"})


def step_c5c1(p):
    return _upd(p, PRED["c5c1"], {a: f"a.{b}" for a, b in zip(A4, B4)})


def step_c5c2_keep(p):
    return f"SELECT * EXCLUDE (last_seq) FROM {LAST.format(p=p)} r WHERE {TOO_EARLY} IS NOT TRUE"


def step_c5c2_anomalies(p):
    return f"SELECT * EXCLUDE (last_seq) FROM {LAST.format(p=p)} r WHERE {TOO_EARLY}"


def step_c5b(p):
    return (f"SELECT * EXCLUDE (last_seq) REPLACE (IF({NO_ALIGHT_SEQ}, last_seq + 1, alight_seq) AS alight_seq) "
            f"FROM {LAST.format(p=p)} r")


def step_c6(p):
    return _upd(p, PRED["c6"], {"alight_name": "a.board_name"})


def step_c7(p):
    return _upd(p, PRED["c7"], {a: f"a.{b}" for a, b in zip(A4, B4)})


def step_c8(p):
    return _upd(p, PRED["c8"], {b: f"a.{a}" for a, b in zip(A4, B4)})


def step_c9(p):
    return _upd(p, PRED["c9"], {"alight_seq": "a.board_seq + 1"})


def step_dedup(p):
    return f"""SELECT service_date, route_name, route_id, board_seq, board_ars, MIN(board_code) AS board_code,
  board_name, alight_seq, alight_ars, MIN(alight_code) AS alight_code, alight_name,
  CAST(SUM(riders) AS INTEGER) AS riders
FROM {p}
GROUP BY service_date, route_name, route_id, board_seq, board_ars, board_name, alight_seq, alight_ars, alight_name"""


def modal_seq(p):
    """Rows with ``new_seq``: the seq most rows of the day, route and boarding stop have."""
    return f"""SELECT r.*, CASE WHEN r.board_seq IS NOT NULL THEN COALESCE(top.seq, r.board_seq) END AS new_seq
FROM {p} r LEFT JOIN (
  SELECT service_date, route_name, board_ars, list(board_seq ORDER BY votes DESC, board_seq NULLS LAST)[1] AS seq
  FROM (SELECT service_date, route_name, board_ars, board_seq, COUNT(*) AS votes FROM {p} GROUP BY ALL) v
  GROUP BY ALL) top
ON r.board_ars = top.board_ars AND r.board_ars <> {V}
   AND r.route_name = top.route_name AND r.service_date = top.service_date"""


def step_k10(p):
    return f"SELECT * EXCLUDE (new_seq) REPLACE (new_seq AS board_seq) FROM ({modal_seq(p)}) m"


def lowest_seq(p):
    """Rows with ``new_seq``: the lowest alighting seq of rows alike in both stops, if they differ by little."""
    return f"""SELECT * EXCLUDE (lo, hi), CASE WHEN alight_seq IS NULL THEN NULL
  WHEN board_seq IS NOT NULL AND board_ars <> {V} AND alight_ars <> {V}
       AND hi - lo BETWEEN 1 AND {SEQ_SPREAD_MAX} THEN lo ELSE alight_seq END AS new_seq
FROM (SELECT *, MIN(alight_seq) OVER alike AS lo, MAX(alight_seq) OVER alike AS hi FROM {p}
      WINDOW alike AS (PARTITION BY service_date, route_name, board_seq, board_ars, alight_ars)) r"""


def step_k11(p):
    return f"SELECT * EXCLUDE (new_seq) REPLACE (new_seq AS alight_seq) FROM ({lowest_seq(p)}) m"


def step_k12a(p):
    return _upd(p, f"a.board_seq = a.alight_seq AND a.board_ars = a.alight_ars AND a.board_ars != {V}",
                {"alight_seq": "a.board_seq + 1"})


def next_stop(p):
    """Rows with ``nxt``: the stop most rows board at one seq later."""
    return f"""SELECT r.*, nxt.stop AS nxt FROM {p} r LEFT JOIN (
  SELECT service_date, route_name, board_seq,
         list({{'ars': board_ars, 'code': board_code, 'name': board_name}} ORDER BY votes DESC,
              board_ars NULLS LAST, board_code NULLS LAST, board_name NULLS LAST)[1] AS stop
  FROM (SELECT service_date, route_name, board_seq, board_ars, board_code, board_name, COUNT(*) AS votes
        FROM {p} GROUP BY ALL) v
  GROUP BY ALL) nxt
ON r.board_seq + 1 = nxt.board_seq AND r.route_name = nxt.route_name AND r.service_date = nxt.service_date"""


def step_k12b(p):
    moved = {"alight_seq": "board_seq + 1", "alight_ars": "nxt.ars", "alight_code": "nxt.code",
             "alight_name": "nxt.name"}
    sets = ", ".join(f"IF(board_ars = alight_ars AND nxt IS NOT NULL, {v}, {k}) AS {k}" for k, v in moved.items())
    return f"SELECT * EXCLUDE (nxt) REPLACE ({sets}) FROM ({next_stop(p)}) m"


GROUP1 = [step_c1, step_c2, step_c4, step_c5a, step_c5c1, step_c5c2_keep, step_c5b, step_c6, step_c7,
          step_c8, step_c9]
GROUP2 = [step_k10, step_k11]
GROUP3 = [step_k12a, step_k12b]


def chain(steps, final: str | None = None, fixtures=("od",), start: str = "od") -> str:
    """WITH <fixtures>, s1 AS (step1(start)), s2 AS (step2(s1)), ... SELECT."""
    parts, prev = [], start
    for i, st in enumerate(steps, 1):
        name = f"s{i}"
        parts.append(f"{name} AS (\n{st(prev)}\n)")
        prev = name
    head = oracle_with(*fixtures)
    body = (",\n" + ",\n".join(parts) + "\n") if parts else ""
    return head + body + (final.format(p=prev) if final else f"SELECT * FROM {prev}")


def step_counts_sql() -> str:
    """Affected rows per group-1 step and date: each step's predicate
    counted on that step's input state (s0 = od ... s10)."""
    order = ["c1", "c2", "c4", "c5a", "c5c1", "c5c2", "c5b", "c6", "c7", "c8", "c9"]
    parts = []
    for i, step in enumerate(order):
        src = "od" if i == 0 else f"s{i}"
        if step == "c5c2":
            body = f"SELECT service_date FROM {LAST.format(p=src)} r WHERE {TOO_EARLY}"
        elif step == "c5b":
            body = f"SELECT service_date FROM {LAST.format(p=src)} r WHERE {NO_ALIGHT_SEQ} AND last_seq IS NOT NULL"
        else:
            body = f"SELECT a.service_date FROM {src} a WHERE {PRED[step]}"
        parts.append(f"n_{step} AS (SELECT service_date, COUNT(*) AS n FROM ({body}) x GROUP BY service_date)")
    dates = "dates AS (SELECT DISTINCT service_date FROM od)"
    cols = ", ".join(f"COALESCE(n_{st}.n, 0) AS {st}" for st in order)
    joins = " ".join(f"LEFT JOIN n_{st} ON n_{st}.service_date = d.service_date" for st in order)
    final = (",\n" + ",\n".join(parts + [dates]) + f"\nSELECT d.service_date, {cols} FROM dates d {joins}")
    return chain(GROUP1, final=" ").rstrip() + final


def group23_counts_sql() -> str:
    """Affected rows per date for K10, K11 (group 2 on the stored table) and
    K12a, K12b (group 3 on the stored table)."""
    none = {"k10": "0", "k11": "0", "k12a": "0", "k12b": "0"}
    changed = {
        "k10": ("new_seq <> board_seq", f"({modal_seq('od')})"),
        "k11": ("new_seq <> alight_seq", f"({lowest_seq('g2a')})"),
        "k12a": (f"board_seq = alight_seq AND board_ars = alight_ars AND board_ars <> {V}", "od"),
        "k12b": ("board_ars = alight_ars AND nxt IS NOT NULL", f"({next_stop('g3a')})"),
    }
    parts = [f"SELECT service_date, {', '.join(f'{v} AS {k}' for k, v in {**none, step: f'COUNT(*) FILTER (WHERE {cond})'}.items())} "
             f"FROM {rows} x GROUP BY service_date" for step, (cond, rows) in changed.items()]
    sums = ", ".join(f"CAST(SUM({k}) AS BIGINT) AS {k}" for k in none)
    return (oracle_with("od") + f",\ng2a AS ({step_k10('od')}),\ng3a AS ({step_k12a('od')})\n"
            + f"SELECT service_date, {sums} FROM (" + "\nUNION ALL\n".join(parts) + ") u GROUP BY service_date")
