"""Column functions on hand-written micro-tables."""

from pyspark.sql import functions as F

from odspark.functions.metrics import gradient_color, grade, hourly_load, pct1, marker_radius
from odspark.functions.text import strip, to_number, zfill, date_label


def test_worked_example(spark):
    # loads 73, 93, 100 on a route whose max load is 108
    df = spark.createDataFrame([(73,), (93,), (100,)], "load long").withColumn("mx", F.lit(108))
    out = df.select("load", pct1("load", "mx").alias("pct")).withColumn("g", grade("pct"))
    got = sorted((r.load, r.pct, r.g) for r in out.collect())
    assert got == [(73, 67.6, "혼잡"), (93, 86.1, "매우혼잡"), (100, 92.6, "매우혼잡")]


def test_grade_edges(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (40.0,), (60.0,), (80.0,)], "p double")
    got = [r.g for r in df.select(grade("p").alias("g")).collect()]
    assert got == ["쾌적", "여유", "보통", "혼잡", "매우혼잡"]


def test_color_ramp(spark):
    vals = [0.0, 25.0, 50.0, 75.0, 100.0, -5.0, 150.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.c for r in df.select(gradient_color("p").alias("c")).collect()]
    assert got == ["#00FF00", "#80FF00", "#FFFF00", "#FF8000", "#FF0000", "#00FF00", "#FF0000"]


def test_color_truncates(spark):
    # 12.5 % -> halfway between the first two anchors: R = int(64.0)
    df = spark.createDataFrame([(12.5,), (37.5,)], "p double")
    got = [r.c for r in df.select(gradient_color("p").alias("c")).collect()]
    assert got == ["#40FF00", "#BFFF00"]


def test_hourly_load_rounding(spark):
    # x / 19 rounded half up; negatives are 0
    df = spark.createDataFrame([(-5,), (0,), (9,), (10,), (28,), (29,), (None,)], "x long")
    got = [r.l for r in df.select(hourly_load("x").alias("l")).collect()]
    assert got == [0, 0, 0, 1, 1, 2, None]


def test_pct_zero_max_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "a long, b long")
    assert df.select(pct1("a", "b").alias("p")).first().p is None


def test_zfill(spark):
    df = spark.createDataFrame([("7511",), ("07511",), ("123456",), (None,)], "a string")
    got = [r.z for r in df.select(zfill("a").alias("z")).collect()]
    assert got == ["07511", "07511", "123456", None]


def test_strip_and_to_number(spark):
    df = spark.createDataFrame([("　 12 \t",), (" x ",), ("3.0",), (None,)], "a string")
    out = df.select(strip("a").alias("s"), to_number(strip("a")).alias("n")).collect()
    assert [r.s for r in out] == ["12", "x", "3.0", None]
    assert [r.n for r in out] == [12.0, None, 3.0, None]


def test_marker_radius_and_label(spark):
    df = spark.createDataFrame([(0.0, "20231017"), (100.0, "20251014"), (33.0, "20241019")],
                               "p double, d string")
    out = df.select(marker_radius("p").alias("r"), date_label("d").alias("l")).collect()
    assert [(r.r, r.l) for r in out] == [(4, "2023-10-17"), (16, "2025-10-14"), (8, "2024-10-19")]
