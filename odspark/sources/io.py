"""Sources and sinks: raw CSV, CSV sinks, the date-partitioned OD store,
materialise-or-reuse and staged publish.

Raw CSV is read with every column as text (leading zeros of ARS codes
survive, nothing is inferred); header names are trimmed. The OD fact is a
parquet table partitioned by ``service_date`` so date filters prune
directories; a publish replaces only the dates being written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odspark.constants import OD_COLUMNS
from odspark.functions.text import MISSING, missing_to_null
from odspark.schema import OD_SCHEMA
from odspark.session import cut_lineage, drop_path


def read_raw_csv(spark: SparkSession, path: str, sep: str = ",", null_value: str | None = None,
                 encoding: str = "UTF-8", missing=MISSING) -> DataFrame:
    """Header CSV, all columns ``StringType``, names trimmed.
    A leading UTF-8 BOM is dropped by the reader; CRLF endings are handled;
    quoted fields may contain the separator. The texts in ``missing`` (and
    ``null_value``, if given) become NULL."""
    r = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
         .option("encoding", encoding).option("quote", '"').option("escape", '"'))
    df = r.csv(path)
    tokens = [*missing, *([] if null_value is None else [null_value])]
    names = [n.strip().lstrip("\ufeff") for n in df.columns]
    df = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return df.select(*[missing_to_null(f"_c{i}", tokens).alias(n) for i, n in enumerate(names)])


BAD_LINE = "bad_line"


def read_checked_csv(spark: SparkSession, path, columns, sep: str = ",", header: bool = True,
                     encoding: str = "UTF-8", missing=MISSING) -> tuple[DataFrame, DataFrame]:
    """S1/S12 with bad records kept: the rows of the named text columns (in file
    order, cleaned as by ``read_raw_csv``) and, as ``bad_line``, the whole lines
    that do not hold exactly these fields. Empty lines are no records. ``path`` is
    a path or a list; with ``header`` the first line of each file is passed over.

    The files are parsed once: what was read is staged, rows and lines come from
    there (Spark refuses to read the bad lines alone from the raw files)."""
    fields = [f"_c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{f} string" for f in [*fields, "_bad"])
    raw = (spark.read.schema(schema).option("header", header).option("sep", sep).option("encoding", encoding)
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).csv(path))
    held = cut_lineage(raw, "csv")
    rows = held.where(F.col("_bad").isNull()).select(*[missing_to_null(f, missing).alias(n) for f, n in zip(fields, columns)])
    return rows, held.where(F.col("_bad").isNotNull()).select(F.col("_bad").alias(BAD_LINE))


def write_csv(df: DataFrame, path: str, sep: str = "|", header: bool = True,
              mode: str = "overwrite") -> None:
    """CSV sink; the pipe separator keeps names containing commas in
    one field, lines end with a bare newline, and quotes inside a value are
    doubled (RFC 4180, as spreadsheet tools and ``read_raw_csv`` expect)."""
    (df.write.mode(mode).option("header", header).option("sep", sep).option("lineSep", "\n")
       .option("quote", '"').option("escape", '"').option("quoteAll", False).csv(path))


def to_od_schema(df: DataFrame) -> DataFrame:
    """Cast an enriched (all-text) table to the typed OD schema; text that
    is not a number becomes NULL instead of failing under ANSI mode."""
    cols = []
    for f in OD_SCHEMA.fields:
        col = F.col(f.name)
        cols.append((col.try_cast(f.dataType) if f.dataType.simpleString() != "string"
                     else col.cast("string")).alias(f.name))
    return df.select(*cols)


def _by_date(df: DataFrame) -> DataFrame:
    """Rows of one date together, big dates over several tasks (the planner
    sizes the parts), so a write makes few files per date."""
    return df.select(*OD_COLUMNS).hint("rebalance", "service_date")


def write_od(df: DataFrame, path: str, mode: str = "overwrite", dates=None) -> None:
    """OD store: parquet partitioned by service date. Only the dates in
    ``df`` are replaced (dynamic partition overwrite); with ``dates``, all of
    these are, also those without rows, which become empty.

    A rebalance by date bounds the files per date and splits a big date by
    size, not by route; rows are then sorted by route and seq, so row groups
    are clustered by route and a route filter skips by parquet statistics."""
    (_by_date(df).sortWithinPartitions("service_date", "route_name", "board_seq")
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy("service_date").parquet(path))
    if dates is not None:
        drop_empty_dates(df, path, dates)


def drop_empty_dates(df: DataFrame, path: str, dates) -> None:
    """Remove the partitions of requested dates that ``df`` has no row of."""
    spark = df.sparkSession
    held = {r[0] for r in df.where(F.col("service_date").isin(list(dates)))
            .select("service_date").distinct().collect()}  # at most the requested dates
    for d in set(dates) - held:
        drop_path(spark, f"{path.rstrip('/')}/service_date={d}")


def read_od(spark: SparkSession, path: str, dates=None) -> DataFrame:
    """OD store scan; ``dates`` prune partitions. The declared schema keeps
    ``service_date`` text (partition discovery would infer an integer).

    ``dates`` is a list, or a table of requests with a ``service_date`` column:
    the semi join on the partition column then prunes the scan at run time
    (dynamic partition pruning), without the dates passing the driver. Spark
    adds the pruning where the requests are filtered and small enough to be
    broadcast; otherwise the join alone picks the rows."""
    df = spark.read.schema(OD_SCHEMA).parquet(path).select(*OD_COLUMNS)
    if isinstance(dates, DataFrame):
        return df.join(dates.select("service_date"), "service_date", "left_semi").select(*OD_COLUMNS)
    return df if dates is None else df.where(F.col("service_date").isin(list(dates)))


def write_anomalies(anomalies: DataFrame, path: str, dates=None) -> None:
    """The anomaly side output, one partition per service date. The
    requested ``dates`` are replaced, also those without anomalies now
    (without ``dates``: the dates present), so a repeated run neither
    duplicates nor keeps stale anomalies; other dates are kept."""
    (_by_date(anomalies).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(path))
    if dates is not None:
        drop_empty_dates(anomalies, path, dates)


def materialize(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Reuse the stored result unless ``refresh`` or it does not exist.
    Any other read error is raised: it must not overwrite a stored table."""
    spark = df.sparkSession
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def publish(df: DataFrame, staging_path: str, final_path: str, checks=None, dates=None) -> DataFrame:
    """Write the produced dates to a staging table of this run, validate
    it there, and only then replace those dates (and the requested ``dates``)
    in the final table. A failed check leaves the final table untouched.

    Each run stages under its own name below ``staging_path``, so nothing of
    an earlier night is read back. ``checks``: callables ``staged_df -> None``
    that raise on failure.
    """
    spark = df.sparkSession
    run_path = f"{staging_path.rstrip('/')}/run-{uuid.uuid4().hex}"
    _by_date(df).write.mode("errorifexists").partitionBy("service_date").parquet(run_path)
    staged = read_od(spark, run_path)
    for check in checks or []:
        check(staged)
    write_od(staged, final_path, mode="overwrite", dates=dates)
    drop_path(spark, run_path)
    return read_od(spark, final_path, dates)


def riders_conserved(expected_total: int):
    """A publish check: the staged table carries exactly these riders."""
    def check(staged: DataFrame) -> None:
        got = staged.agg(F.sum("riders")).first()[0] or 0
        if got != expected_total:
            raise ValueError(f"riders not conserved: expected {expected_total}, staged {got}")
    return check


# --------------------------------------------------------------------------
# Reuse by the fingerprint of the inputs
FINGERPRINTS = "_inputs"  # a name that table scans pass over


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(service_date, fingerprint) of a date-partitioned table: a digest of the
    names, sizes and times of each date's files. The files are listed by Spark;
    no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    date = F.regexp_extract("path", "service_date=([^/]+)/", 1)
    mark = F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256)
    return (files.select(date.alias("service_date"), mark.alias("mark")).groupBy("service_date")
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("mark")), ""), 256).alias("fingerprint")))


def rows_fingerprint(df: DataFrame) -> str:
    """A digest of a (dimension) table's rows, whatever their order."""
    row = F.xxhash64(*[F.struct(F.col(f"`{n}`").isNull(), F.col(f"`{n}`")) for n in df.columns])
    n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()  # one row
    return f"{df.schema.simpleString()}:{n}:{total}"


def refresh_dates(spark: SparkSession, source: str, path: str, compute, parameters: str = "") -> list[str]:
    """Bring the stored result at ``path`` up to date; the dates that changed.

    ``source`` is a date-partitioned table, ``compute(dates)`` gives the result
    rows (with ``service_date``) of those dates from it. A date is computed again
    when its files, or ``parameters`` (a text: settings, ``rows_fingerprint`` of
    side tables), differ from those its stored rows came from; the files of all
    other dates stay as they are. A date that has left the source is removed.

    The fingerprints stand beside the rows. That of a changed date is removed
    before its rows are replaced and written after them, so a killed run leaves
    a date to be computed again, never one that looks current and is not."""
    held_at = f"{path.rstrip('/')}/{FINGERPRINTS}"
    # a row per date on the driver
    now = {r.service_date: f"{r.fingerprint}:{parameters}" for r in file_fingerprints(spark, source).collect()}
    held = {r.service_date: r.fingerprint for r in _stored_fingerprints(spark, held_at).collect()}
    stale = sorted(d for d, f in now.items() if held.get(d) != f)
    gone = sorted(set(held) - set(now))
    for d in stale + gone:
        drop_path(spark, f"{held_at}/service_date={d}")
        # also a changed date's rows: it may have none now
        drop_path(spark, f"{path.rstrip('/')}/service_date={d}")
    if stale:
        rows = compute(stale)
        (rows.hint("rebalance", "service_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("service_date").parquet(path))
        marks = spark.createDataFrame([(d, now[d]) for d in stale], "service_date string, fingerprint string")
        (marks.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("service_date").parquet(held_at))
    return stale + gone


def _stored_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    schema = "fingerprint string, service_date string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
