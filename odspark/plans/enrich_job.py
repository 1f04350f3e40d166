"""Enrichment job: raw target-day and reference-day CSVs in, enriched
pipe-separated CSV out, NULL report printed (one JSON line).

``python -m odspark.plans.enrich_job --target T.csv --reference R.csv --out DIR [--stages 3]
[--od-store PATH]``

With ``--od-store`` the typed rows are also written to the date-partitioned
OD table (only the dates in the file are replaced).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from odspark.operators import enrich as en
from odspark.session import staging
from odspark.sources import io


def run(spark: SparkSession, target: str, reference: str, out: str, stages: int = 3,
        od_store: str | None = None, null_value: str | None = None) -> dict:
    with staging(spark):
        enriched = en.enrich_od(io.read_raw_csv(spark, target, null_value=null_value),
                                io.read_raw_csv(spark, reference, null_value=null_value),
                                fill_stages=stages)
        io.write_csv(enriched, out, sep="|")
    written = io.read_raw_csv(spark, out, sep="|")      # report on what was written
    if od_store:
        io.write_od(io.to_od_schema(written), od_store)
    return en.null_report(written).first().asDict()


def main(argv: list[str] | None = None) -> None:
    import argparse

    ap = argparse.ArgumentParser(prog="odspark.plans.enrich_job")
    ap.add_argument("--target", required=True)
    ap.add_argument("--reference", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--stages", type=int, default=3, choices=[1, 2, 3])
    ap.add_argument("--od-store")
    ap.add_argument("--null-value")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("odspark-enrich").getOrCreate()
    print(json.dumps(run(spark, args.target, args.reference, args.out, args.stages, args.od_store,
                         args.null_value)))


if __name__ == "__main__":
    main()
