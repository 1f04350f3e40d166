"""Query registry: name -> (spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables through
the fixture views and runs over all dates and routes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odspark.operators import congestion as cg
from odspark.plans import oracle as O
from odspark.sources.fixtures import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: f() for k, f in _ORACLE.items()}


_loaded = False


def _load_all() -> None:
    global _loaded
    if _loaded:
        return
    _loaded = True
    # modules below register their queries on import
    from odspark.plans import queries_analytics  # noqa: F401
    from odspark.plans import queries_correct  # noqa: F401
    from odspark.plans import queries_enrich  # noqa: F401
    from odspark.plans import queries_reports  # noqa: F401
    from odspark.plans import queries_forecast  # noqa: F401


def T(spark: SparkSession, sf_dir: str) -> Tables:
    """Fixture tables, shared by all queries of one session and directory.
    They live on the session object and go with it."""
    held = spark.__dict__.setdefault("_odspark_tables", {})
    return held.setdefault(sf_dir.rstrip("/"), Tables(spark, sf_dir))


@register("congestion_by_route", O.q_congestion_by_route)
def congestion_by_route(spark, sf_dir):
    t = T(spark, sf_dir)
    return cg.congestion(t.od(), t.loc())
