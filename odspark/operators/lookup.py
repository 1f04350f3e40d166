"""Finder lookups (F3..F6) in batch form.

The original finds rows for one value per call (one ARS, one route). Here a
lookup takes either a list of values — a filter that reaches the parquet
scan — or a DataFrame of requested keys, which becomes a left semi join
(broadcast when the key table is small, sort-merge otherwise), so any
number of keys is served by one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.session import cut_lineage


def find_by(od: DataFrame, column: str, keys) -> DataFrame:
    if isinstance(keys, DataFrame):
        # staged: their stored size is known before ``od`` would be shuffled by a hot key
        k = cut_lineage(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), "looked-up")
        return od.join(k, column, "left_semi")
    return od.where(F.col(column).isin(list(keys)))


def by_board_ars(od: DataFrame, keys) -> DataFrame:
    """F5."""
    return find_by(od, "board_ars", keys)


def by_route(od: DataFrame, keys) -> DataFrame:
    """F6."""
    return find_by(od, "route_name", keys)


def null_codes(od: DataFrame, end: str = "board") -> DataFrame:
    """Rows whose standard code is NULL (all dates)."""
    return od.where(F.col(f"{end}_code").isNull())
