"""Map-ready layer tables (segments, markers, network congestion, density).

The original builds these per date and per route in driver loops; here
each layer is one DataFrame over all dates and routes, keyed by
``service_date``. Per-date scalars (network max, densest stop) are partial
aggregates over the staged per-stop table, joined back on the date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odspark.constants import LEGEND
from odspark.functions.metrics import gradient_color, marker_radius, pct1, text_color
from odspark.functions.text import date_label
from odspark.operators.congestion import ROUTE_KEY, stop_order
from odspark.operators.od import nested_od
from odspark.session import cut_lineage


def mapped(cong: DataFrame) -> DataFrame:
    """congestion rows that can be drawn (coordinates known)."""
    return cong.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _beside_day_max(rows: DataFrame, measure: str, name: str) -> DataFrame:
    """``name``: the largest ``measure`` of the row's date. The per-stop rows
    are staged, their maxima are a partial aggregate (one row per date), and
    the small result is joined back: no task sees a whole date."""
    rows = cut_lineage(rows, "per-stop")
    peak = rows.groupBy("service_date").agg(F.max(measure).alias(name))
    return rows.join(peak, "service_date")


def network_congestion(cong: DataFrame) -> DataFrame:
    """Load relative to the largest load of any mapped stop on that
    date (0 when that max is not positive); the grade stays the route's."""
    return (_beside_day_max(mapped(cong), "load", "network_max_load")
            .withColumn("network_pct",
                        F.when(F.col("network_max_load") > 0, pct1("load", "network_max_load"))
                        .otherwise(F.lit(0.0)))
            .withColumn("network_color", gradient_color("network_pct")))


def segments(cong: DataFrame) -> DataFrame:
    """Consecutive mapped stops of each route joined into segments,
    coloured by the start stop (route and network scale)."""
    net = network_congestion(cong)
    w = Window.partitionBy(*ROUTE_KEY).orderBy(*stop_order())
    nxt = lambda c: F.lead(c).over(w)
    seg = (net.select(*ROUTE_KEY, "seq", "ars", "stop_name", "lat", "lon", "pct", "grade", "color",
                      "network_pct", "network_color",
                      nxt("stop_name").alias("to_name"), nxt("lat").alias("to_lat"),
                      nxt("lon").alias("to_lon"), F.row_number().over(w).alias("pos"))
           .where(F.col("to_lat").isNotNull()))
    return seg.select(*ROUTE_KEY, "pos", F.col("stop_name").alias("from_name"), "to_name",
                      F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"),
                      "to_lat", "to_lon", "pct", "grade", "color", "network_pct", "network_color")


def markers(cong: DataFrame, od: DataFrame) -> DataFrame:
    """One marker per mapped stop with the OD popup payload (X18) as
    JSON arrays, the date label and the colours of the two popup headers
    (fill: ``color`` / ``network_color``; text: by the same percent)."""
    payload = nested_od(od).select(
        "service_date", "route_name", "ars",
        F.to_json(F.coalesce("destinations", F.array().cast(
            "array<struct<stop_name:string,riders:bigint>>"))).alias("destinations"),
        F.to_json(F.coalesce("origins", F.array().cast(
            "array<struct<stop_name:string,riders:bigint>>"))).alias("origins"))
    net = network_congestion(cong)
    return (net.join(payload, ["service_date", "route_name", "ars"], "left")
            .select(*ROUTE_KEY, date_label("service_date").alias("date_label"), "seq", "ars",
                    "stop_name", "lat", "lon", "load", "total_riders", "pct", "grade", "color",
                    text_color("pct").alias("text_color"), "network_pct", "network_color",
                    text_color("network_pct").alias("network_text_color"),
                    F.coalesce("destinations", F.lit("[]")).alias("destinations"),
                    F.coalesce("origins", F.lit("[]")).alias("origins")))


def stop_density(cong: DataFrame) -> DataFrame:
    """Summed load per physical stop across routes, percent of the
    day's densest stop, colour and marker radius."""
    dens = (mapped(cong).where(F.col("stop_name").isNotNull())
            .groupBy("service_date", "ars", "stop_name", "lat", "lon")
            .agg(F.sum("load").cast("long").alias("total_load")))
    out = (_beside_day_max(dens, "total_load", "max_total_load")
           .withColumn("density_pct",
                       F.when(F.col("max_total_load") > 0, pct1("total_load", "max_total_load"))
                       .otherwise(F.lit(0.0))))
    return (out.withColumn("color", gradient_color("density_pct"))
            .withColumn("radius", marker_radius("density_pct"))
            .select("service_date", "ars", "stop_name", "lat", "lon", "total_load",
                    "density_pct", "color", "radius"))


def legend(spark: SparkSession) -> DataFrame:
    """The constant legend table (grade, range, colour)."""
    return spark.createDataFrame(LEGEND, "grade string, pct_range string, color string")
