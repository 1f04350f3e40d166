"""The nightly correction job (K17) over the stored OD table.

One Spark job per run, for any number of service dates: read those dates'
input, run group 1 (virtual stops) -> group 2 (sequences) -> group 3
(same-stop OD), each ending in dedup, cut the lineage at each group
boundary (a parquet table under the shared checkpoint directory), and
check that riders are conserved (riders in = riders out + anomalies).

``run_snapshot`` keeps input, corrected rows and anomalies as run snapshots
(``sources.snapshots``): one pointer switches the dates of all three, so a run
may be killed at any point and repeated any number of times, also "in place".
``run_nightly`` writes plain date partitions from a source that it does not
replace; repeated, it computes the same rows from the same source.

The riders are counted by the writes themselves (``DataFrame.observe``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odspark.operators import correct as cr
from odspark.session import cut_lineage, staging
from odspark.sources import io
from odspark.sources.snapshots import Snapshots, total_riders


@dataclass
class NightlyResult:
    corrected: DataFrame
    anomalies: DataFrame
    step_counts: DataFrame      # affected rows per group-1 step and date
    residuals: DataFrame        # A13 checks after group 1
    bidirectional: DataFrame    # C3: routes to check by hand, per date
    riders_in: int


def correct_all(od: DataFrame) -> NightlyResult:
    """Run the three groups; every frame returned is backed by a written
    table, so consumers do not recompute the chain. The first of these writes
    counts the riders that came in (above the aggregate: a metric below it is
    lost when the shuffle turns out empty)."""
    folded = cr.FoldedGroup1(cr.group1_tagged(od))
    folded.rows, riders_in = total_riders(folded.rows)
    folded.rows = cut_lineage(folded.rows, "group1")
    g1 = cut_lineage(folded.dedup(), "group1_dedup")
    g2 = cut_lineage(cr.fix_sequence(g1), "group2")
    g3 = cr.fix_same_stop_od(g2)
    # staged like the rest: the job may replace the table that ``od`` reads
    bidirectional = cut_lineage(cr.detect_bidirectional(od), "bidirectional")
    return NightlyResult(g3, folded.anomalies(), folded.counts(), cr.residual_counts(g1), bidirectional,
                         riders_in.get["riders"])


def run_snapshot(store: Snapshots, dates: list[str], source: DataFrame | None = None) -> NightlyResult:
    """Correct these dates of a snapshot store. With ``source``, its rows of
    these dates become their input first; otherwise the input that the store
    keeps is corrected again. Input, result and anomalies are switched together."""
    seen, run, tables = store.pointer(), store.new_run(), ["od", "anomalies"]
    if source is None:
        od = store.read("input", dates)
    else:
        store.write(run, "input", source.where(F.col("service_date").isin(list(dates))))
        od, tables = store.written(run, "input"), ["input", *tables]
    res = correct_all(od)
    out = {t: store.write(run, t, df) for t, df in (("od", res.corrected), ("anomalies", res.anomalies))}
    if res.riders_in != sum(out.values()):
        raise ValueError(f"riders not conserved: {res.riders_in} in, {out} written")
    store.switch(run, tables, dates, seen)
    return res


def update_codes(store: Snapshots, updates: DataFrame, end: str = "board") -> list[str]:
    """K15 on a snapshot store: set ``{end}_code`` where ``updates`` (service_date,
    route_name, board_ars, alight_ars, code) says so, in the kept input and in the
    corrected rows; the dates rewritten. Only dates that both the updates and the
    store hold are read and written; the files of all others stay as they are, and
    one pointer switches the rewritten ones, so a killed update changes nothing."""
    seen, run = store.pointer(), store.new_run()
    stored = {d for t, d in seen if t in ("input", "od")}
    named = updates.where(F.col("code").isNotNull()).select("service_date").distinct()
    dates = sorted({r[0] for r in named.collect()} & stored)  # a row per date
    if not dates:
        return []
    tables = [t for t in ("input", "od") if any((t, d) in seen for d in dates)]
    for t in tables:
        before, riders = total_riders(store.read(t, dates))
        after = store.write(run, t, cr.apply_code_updates(before, updates, end))
        if riders.get["riders"] != after:
            raise ValueError(f"riders not conserved in {t}: {riders.get['riders']} read, {after} written")
    store.switch(run, tables, dates, seen)
    return dates


def run_nightly(spark: SparkSession, od_path: str, final_path: str, staging_path: str,
                anomaly_path: str, dates: list[str]) -> NightlyResult:
    """Corrected rows and anomalies of ``dates`` as plain date partitions. The
    source must be another table than the result: a table that is corrected in
    place needs its input kept, see ``run_snapshot``."""
    if od_path.rstrip("/") == final_path.rstrip("/"):
        raise ValueError("a table corrected in place loses its anomalies when the job is repeated; use run_snapshot")
    res = correct_all(io.read_od(spark, od_path, dates))
    staged, riders = total_riders(res.anomalies)
    anomalies = cut_lineage(staged, "anomalies")
    io.publish(res.corrected, staging_path, final_path,
               checks=[io.riders_conserved(res.riders_in - riders.get["riders"])], dates=dates)
    io.write_anomalies(anomalies, anomaly_path, dates=dates)
    return res


def main(argv: list[str] | None = None) -> None:
    """``python -m odspark.plans.pipeline --store PATH --report PATH
    --date 20251014 [--date ...] [--od PATH]``

    Runs the nightly job for the given dates of a snapshot store in the current
    (or a new) session and writes the per-step counts and residual checks to
    ``--report`` (one partition per date, replaced on re-runs). ``--od`` names a
    date-partitioned OD table whose rows of these dates arrive as new input.
    """
    import argparse

    ap = argparse.ArgumentParser(prog="odspark.plans.pipeline")
    for name in ("store", "report"):
        ap.add_argument(f"--{name}", required=True)
    ap.add_argument("--od")
    ap.add_argument("--date", action="append", required=True)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("odspark-nightly").getOrCreate()
    with staging(spark):
        source = io.read_od(spark, args.od, args.date) if args.od else None
        res = run_snapshot(Snapshots(spark, args.store), args.date, source)
        flagged = res.bidirectional.groupBy("service_date").agg(
            F.sort_array(F.collect_set("route_name")).alias("bidirectional_routes"))
        report = (res.step_counts.join(res.residuals, "service_date", "full")
                  .join(flagged, "service_date", "left"))
        (report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("service_date").parquet(args.report))


if __name__ == "__main__":
    main()
