"""Table schemas (English snake_case names)."""

from pyspark.sql import types as T

OD_SCHEMA = T.StructType([
    T.StructField("service_date", T.StringType()),   # yyyyMMdd text
    T.StructField("route_name", T.StringType()),
    T.StructField("route_id", T.LongType()),
    T.StructField("board_seq", T.IntegerType()),
    T.StructField("board_ars", T.StringType()),      # 5-char text, never int
    T.StructField("board_code", T.StringType()),     # 9-char standard code
    T.StructField("board_name", T.StringType()),
    T.StructField("alight_seq", T.IntegerType()),
    T.StructField("alight_ars", T.StringType()),
    T.StructField("alight_code", T.StringType()),
    T.StructField("alight_name", T.StringType()),
    T.StructField("riders", T.IntegerType()),
])
