"""Run snapshots of the nightly job: a pointer table from date to run.

Layout below ``root``::

    input/run=<id>/service_date=<d>/      rows as they arrived
    od/run=<id>/service_date=<d>/         corrected rows
    anomalies/run=<id>/service_date=<d>/  rows that were taken out
    pointers/<version>                    table, date and run that readers see

A run writes new folders only and then adds one pointer file, which switches
all its dates in all tables in one step. A run that is killed before that
changes nothing; one that is repeated starts from the input that is kept, not
from its own result. A date without rows in a table has no pointer there.
Pointers hold a line per table and date, so they are small; all rows are read
and written by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from odspark.constants import OD_COLUMNS
from odspark.schema import OD_SCHEMA
from odspark.session import drop_path

TABLES = ("input", "od", "anomalies")
_POINTER = "name string, service_date string, run string"


class ConcurrentRun(RuntimeError):
    """Another run switched one of this run's dates meanwhile."""


def total_riders(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and the riders it holds, gathered by the action that writes it."""
    seen = Observation()
    return df.observe(seen, F.coalesce(F.sum("riders"), F.lit(0)).cast("long").alias("riders")), seen


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("pointers") if n.isdigit())

    def pointer(self, version: int | None = None) -> dict[tuple[str, str], str]:
        """(table, date) -> run, as of a version (default: the last)."""
        held = self.versions()
        if not held:
            return {}
        path = f"{self.root}/pointers/{held[-1] if version is None else version:010}"
        rows = self.spark.read.schema(_POINTER).option("sep", "\t").csv(path).collect()  # a row per table and date
        return {(r.name, r.service_date): r.run for r in rows}

    def read(self, table: str, dates=None, version: int | None = None) -> DataFrame:
        """The rows of a table that the pointer names, for all or some dates."""
        runs = {d: r for (t, d), r in self.pointer(version).items() if t == table and (dates is None or d in set(dates))}
        paths = [f"{self.root}/{table}/run={r}/service_date={d}" for d, r in sorted(runs.items())]
        if not paths:
            return self.spark.createDataFrame([], OD_SCHEMA).select(*OD_COLUMNS)
        return (self.spark.read.schema(OD_SCHEMA).option("basePath", f"{self.root}/{table}").parquet(*paths)
                .select(*OD_COLUMNS))

    def new_run(self) -> str:
        return uuid.uuid4().hex

    def write(self, run: str, table: str, df: DataFrame) -> int:
        """Write a run's rows of one table, partitioned by date; their riders.
        The riders are counted by the tasks that write the files."""
        rows, riders = total_riders(df.select(*OD_COLUMNS).hint("rebalance", "service_date"))
        rows.write.mode("errorifexists").partitionBy("service_date").parquet(f"{self.root}/{table}/run={run}")
        return riders.get["riders"]

    def written(self, run: str, table: str) -> DataFrame:
        """A run's own rows, before it is switched to."""
        return self.spark.read.schema(OD_SCHEMA).parquet(f"{self.root}/{table}/run={run}").select(*OD_COLUMNS)

    def switch(self, run: str, tables, dates, seen: dict[tuple[str, str], str]) -> int:
        """Point these dates of these tables to ``run``; the new version. ``seen``
        is the pointer the run started from."""
        held = {t: {n.partition("=")[2] for n in self._names(t, f"run={run}")} for t in tables}
        mine = {(t, d) for t in TABLES for d in dates}
        while True:
            last = self.versions()
            now = self.pointer()
            changed = sorted(k for k in mine if now.get(k) != seen.get(k))
            if changed:
                raise ConcurrentRun(f"another run replaced {changed}")
            entries = {k: r for k, r in now.items() if k[0] not in tables or k[1] not in set(dates)}
            entries |= {(t, d): run for t in tables for d in dates if d in held[t]}
            version = (last[-1] if last else 0) + 1
            if self._add_pointer(version, entries):
                return version

    def _add_pointer(self, version: int, entries: dict[tuple[str, str], str]) -> bool:
        """Write the pointer under another name, then rename it; False if the version exists by now."""
        target, fs = self._path("pointers", f"{version:010}")
        draft, _ = self._path("pointers", f"_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray("".join(f"{t}\t{d}\t{r}\n" for (t, d), r in sorted(entries.items())).encode()))
        out.close()
        if not fs.exists(target) and fs.rename(draft, target):
            return True
        fs.delete(draft, False)
        return False

    def vacuum(self, keep: int = 1) -> int:
        """Remove the runs that none of the last ``keep`` pointers names; how many folders went.
        To be called while no run is writing."""
        held = self.versions()
        used = {(t, r) for v in held[-keep:] for (t, _), r in self.pointer(v).items()}
        gone = [(t, n) for t in TABLES for n in self._names(t) if (t, n.partition("=")[2]) not in used]
        for t, n in gone:
            drop_path(self.spark, f"{self.root}/{t}/{n}")
        for v in held[:-keep]:
            drop_path(self.spark, f"{self.root}/pointers/{v:010}")
        return len(gone)
