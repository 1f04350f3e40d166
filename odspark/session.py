"""SparkSession helpers.

The library never picks storage locations on a cluster: the lineage cut
(``checkpoint``) uses the directory the cluster names in
``spark.checkpoint.dir``. Only local sessions built by tests or the bench
set their own directory, and only when the setting is absent.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from measured shuffle
# sizes (broadcast only when the measured side is small, sort-merge beyond),
# coalesces small partitions and splits skewed ones.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "odspark") -> SparkSession:
    """Local session for tests and the bench (clusters bring their own)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared staging folder: ``spark.checkpoint.dir`` of the session.

    A cluster must name it. Only a local master without the setting gets a
    folder of its own (tests, bench); anything else fails here, before any
    work is done, because staged tables must be visible to every executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        sc = None
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf_dir and sc is not None and re.match(r"local(\[|$)", sc.master):
        conf_dir = tempfile.mkdtemp(prefix="odspark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not conf_dir:
        raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that the "
                         "driver and all executors share")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def staged_path(spark: SparkSession, name: str) -> str:
    """A run-unique path under the shared staging folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/odspark-tables/{name}-{uuid.uuid4().hex}"


_STAGED: list[list[str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table folder through the session's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def staging(spark: SparkSession):
    """Tables staged inside this block are removed when it ends. Frames that
    read them must be written out before."""
    _STAGED.append([])
    try:
        yield
    finally:
        for path in _STAGED.pop():
            drop_path(spark, path)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage by writing ``df`` as a parquet table under the shared
    ``spark.checkpoint.dir`` and reading it back.

    The written table survives executor loss like a reliable checkpoint,
    and unlike an RDD checkpoint its reads keep column pruning and filter
    pushdown.
    """
    path = staged_path(df.sparkSession, name)
    if _STAGED:
        _STAGED[-1].append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MAX_SHUFFLE_PARTITIONS = 20_000


def cluster_settings(input_bytes: int, total_cores: int,
                     target_partition_bytes: int = 256 << 20,
                     shuffled_share: float = 0.1) -> dict:
    """SQL settings sized for a cluster run over ``input_bytes`` of OD data.

    * scans split at 256 MB, so a task reads a bounded slice whatever the
      table size;
    * the initial shuffle partition count follows the bytes that reach a
      shuffle, not the input: aggregates combine on the map side, so
      ``shuffled_share`` of the input at most is assumed; at least 2 waves of
      the cores, and never more than MAX_SHUFFLE_PARTITIONS, because the
      driver tracks map tasks times partitions. AQE coalesces small
      partitions to the advisory size and splits skewed ones;
    * broadcasts stay capped at 64 MB of measured size — larger sides
      sort-merge.
    """
    shuffled = int(input_bytes * shuffled_share)
    parts = min(MAX_SHUFFLE_PARTITIONS, max(2 * total_cores, -(-shuffled // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }


def apply_settings(spark: SparkSession, settings: dict) -> None:
    for k, v in settings.items():
        spark.conf.set(k, v)
