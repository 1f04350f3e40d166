"""Map build job: congestion once, every layer table from it.

The original's map script fetched congestion and OD per date over HTTP and
built three layers per date in loops. Here congestion for all routes and
dates is computed once and staged (a parquet table under the checkpoint
directory, or ``cache_path`` when the result is to be served repeatedly),
and the layer tables are derived from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odspark.operators import congestion as cg
from odspark.operators import layers as ly
from odspark.session import cut_lineage
from odspark.sources import io

CONGESTION_SCHEMA = ("route_name string, seq int, ars string, stop_name string, load bigint, max_load bigint, pct double, "
                     "grade string, color string, lat double, lon double, total_riders bigint, service_date string")


def refresh_congestion(spark: SparkSession, od_path: str, loc: DataFrame, cache_path: str) -> list[str]:
    """The stored congestion table of a date-partitioned OD store, brought up to
    date: only dates whose files changed are computed again (all of them when the
    stop locations did); the dates that were. ``read_congestion`` reads it."""
    return io.refresh_dates(spark, od_path, cache_path, lambda dates: cg.congestion(io.read_od(spark, od_path, dates), loc),
                            parameters=io.rows_fingerprint(loc))


def read_congestion(spark: SparkSession, cache_path: str, dates=None) -> DataFrame:
    """The stored congestion rows; ``dates`` prune partitions."""
    df = spark.read.schema(CONGESTION_SCHEMA).parquet(cache_path)
    return df if dates is None else df.where(F.col("service_date").isin(list(dates)))


def build_map_layers(od: DataFrame, loc: DataFrame, cache_path: str | None = None,
                     refresh: bool = False) -> dict[str, DataFrame]:
    """Segments, markers, network congestion, stop density and legend.
    With ``cache_path`` the congestion table is materialised there (S9:
    reused unless ``refresh``), which is also what a request-serving layer
    reads from."""
    cong = cg.congestion(od, loc)
    cong = io.materialize(cong, cache_path, refresh) if cache_path else cut_lineage(cong, "congestion")
    return {
        "congestion": cong,
        "segments": ly.segments(cong),
        "markers": ly.markers(cong, od),
        "network": ly.network_congestion(cong),
        "density": ly.stop_density(cong),
        "legend": ly.legend(od.sparkSession),
    }
