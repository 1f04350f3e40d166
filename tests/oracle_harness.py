"""Run a registered Spark query and its DuckDB oracle side by side.

Mirrors the driver's check: row count, column names + type family, and an
order-insensitive comparison of the values.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family_spark(t: str) -> str:
    t = t.lower()
    if t in ("int", "bigint", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    if t == "string":
        return "str"
    if t == "date":
        return "date"
    if t.startswith("timestamp"):
        return "ts"
    if t == "boolean":
        return "bool"
    return t


def _family_duck(t: str) -> str:
    t = t.upper()
    if t in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER"):
        return "int"
    if t in ("DOUBLE", "FLOAT") or t.startswith("DECIMAL"):
        return "float"
    if t == "VARCHAR":
        return "str"
    if t == "DATE":
        return "date"
    if t.startswith("TIMESTAMP"):
        return "ts"
    if t == "BOOLEAN":
        return "bool"
    return t


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, _dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def compare(spark_df, con, sql: str, max_show: int = 3):
    s_cols = [f.name for f in spark_df.schema.fields]
    s_types = {f.name: _family_spark(f.dataType.simpleString()) for f in spark_df.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: _family_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
    raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    d_rows = [tuple(_norm(r[idx[c]]) for c in sorted(d_cols)) for r in raw]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}")
    else:
        bad = [c for c in s_cols if s_types[c] != d_types[c]]
        if bad:
            problems.append("types differ: " + ", ".join(f"{c}: {s_types[c]} vs {d_types[c]}" for c in bad))
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    if not problems or len(s_rows) == len(d_rows):
        a, b = sorted(s_rows, key=key), sorted(d_rows, key=key)
        if a != b:
            sa, sb = set(a), set(b)
            problems.append(f"values differ: spark-only {list(sa - sb)[:max_show]} duck-only {list(sb - sa)[:max_show]}")
    return (not problems), problems, len(s_rows)
