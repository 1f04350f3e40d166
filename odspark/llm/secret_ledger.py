"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed: its blob is the
SHA-256 of its text's UTF-8 bytes. The ledger is a Parquet folder with a row per
scanned blob: the (kind, version) pairs of the rules it was scanned with and the
spans they found. A run

1. addresses all versions (text stays where it is; a small row per version);
2. picks one version for each blob and subtracts the ledger: what is left are
   the unseen pairs of blob and rule version. A blob that a third of all rows
   hold is one row per task here, and one text in the scan;
3. reads only the texts of these picked versions, runs only the rules they lack
   and appends the rows to the ledger;
4. joins the ledger's findings back to all versions of all paths.

A ledger row says both what was scanned and what was found, so an append that
ended half way leaves a right ledger: the next run scans the rest. A changed
rule gets a new version and is run again, the other rules are not.

Defined results: a null text is the empty text; null paths and versions are
values like others; repeated rows (same path, version and text) each get the
findings; a picked version that is repeated is scanned by every task that holds
one of its rows, which changes nothing, as a blob's spans are told apart; a very long text is scanned whole, by one task; an empty table gives
an empty result and writes nothing; only the key columns and the text are read,
so other columns cannot clash. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odspark.llm.staging import staged

SCHEMA = ("blob binary, scanned array<struct<kind:string,version:int>>, "
          "spans array<struct<kind:string,version:int,start:long,end:long>>")


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0


# The base rules, then well-known shapes of other secrets. Letters are ASCII.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = BASE + (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", 1, r"(?:gh[oprsu]_|glpat-)[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", 1, r"://[^\s/:@]{1,256}:[^\s/:@]{6,256}@"),
)


@lru_cache(maxsize=256)
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII)


def find_spans(text: str, rules) -> list[tuple[str, int, int, int]]:
    """(kind, version, start, end) of every match, in order of the rules."""
    return [(r.kind, r.version, *m.span()) for r in rules for m in _compiled(r).finditer(text)
            if len(m.group(r.group)) >= r.least]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none when there is no ledger yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(ledger)


def address(versions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Key columns and blob of every version."""
    return versions.select(*keys, F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("blob"))


def unseen(addressed: DataFrame, known: DataFrame, keys: list[str], rules) -> DataFrame:
    """One version of every blob that lacks rules, with the numbers of these rules."""
    one = addressed.groupBy("blob").agg(F.min(F.struct(*keys)).alias("one"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = (known.select("blob", F.explode("scanned").alias("pair")).distinct()
            .groupBy("blob").agg(F.collect_list("pair").alias("seen")))
    lacking = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)),
                       lambda i: ~F.coalesce(F.array_contains(F.col("seen"), F.get(wanted, i)), F.lit(False)))
    return (one.join(seen, "blob", "left").select("blob", "one", lacking.alias("lacking"))
            .where(F.size("lacking") > 0))


def scan(texts: DataFrame, rules) -> DataFrame:
    """Ledger rows of (blob, lacking, text); equal blobs of one batch are scanned once."""
    rules = tuple(rules)
    pair = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32())]))
    span = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            out = {}
            for i in range(b.num_rows):
                blob = b.column(0)[i].as_py()
                if blob not in out:
                    mine = [rules[k] for k in b.column(1)[i].as_py()]
                    found = find_spans(b.column(2)[i].as_py() or "", mine)
                    out[blob] = ([dict(kind=r.kind, version=r.version) for r in mine],
                                 [dict(kind=k, version=v, start=s, end=e) for k, v, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.binary()), pa.array([v[0] for v in out.values()], pair),
                 pa.array([v[1] for v in out.values()], span)], names=["blob", "scanned", "spans"])

    return texts.select("blob", "lacking", "text").mapInArrow(run, SCHEMA)


def scan_versions(versions: DataFrame, ledger: str, keys: list[str], rules=RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger has not seen, then all versions with their findings:
    keys, blob (binary) and spans (kind, version, start, end), ordered by start
    and rule. ``keys`` name a version, such as path and revision."""
    spark = versions.sparkSession
    addressed = staged(address(versions, keys, text), "blobs")
    todo = staged(unseen(addressed, read_ledger(spark, ledger), keys, rules), "unseen")
    if not todo.isEmpty():
        raw = address(versions.select(*keys, F.col(text).cast("string").alias(text)).withColumn("_text", F.col(text)),
                      [*keys, "_text"], text)
        here = todo.select(F.col("blob").alias("_b"), "lacking", *[F.col(f"one.{k}").alias(f"_k{i}") for i, k in enumerate(keys)])
        same = F.col("blob") == F.col("_b")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        picked = raw.join(here, same).select("blob", "lacking", F.col("_text").alias("text"))
        scan(picked, rules).write.mode("append").parquet(ledger)
    found = staged(findings(read_ledger(spark, ledger), rules), "findings")
    none = F.array().cast("array<struct<kind:string,version:int,start:long,end:long>>")
    return addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def findings(known: DataFrame, rules=RULES) -> DataFrame:
    """The spans of the given rules' versions by blob, ordered by start and rule."""
    place = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(r.version)) for r in rules])
    s = (known.select("blob", F.explode("spans").alias("s")).distinct()
         .withColumn("rule", F.array_position(place, F.concat_ws(":", "s.kind", "s.version"))).where("rule > 0"))
    rows = F.array_sort(F.collect_list(F.struct("s.start", "rule", "s")))
    return s.groupBy("blob").agg(rows.alias("rows")).select("blob", F.col("rows.s").alias("spans"))


def listed(spans, kinds=None):
    """kind:start:end of the spans, comma-joined; of the given kinds alone if any."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
