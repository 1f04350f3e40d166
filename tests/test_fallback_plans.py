"""Same results when joins cannot broadcast (sort-merge fallback) and when
AQE splits 'skewed' partitions aggressively."""

import pytest

import __spark_entry__ as E
from conftest import rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["congestion_by_route", "section_congestion", "map_markers", "correct_pipeline",
         "fix_sequence", "fill_null_codes_board", "enrich_od", "restore_codes_master", "report_4_1",
         "hour_split", "code_updates"]

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.shuffle.partitions": "13",
}


@pytest.mark.parametrize("name", NAMES)
def test_sort_merge_and_skew_split_agree(spark, name):
    q = E.queries()[name]
    expected = rows_of(q(spark, SF))
    saved = {k: spark.conf.get(k, None) for k in FORCED}
    try:
        for k, v in FORCED.items():
            spark.conf.set(k, v)
        df = q(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = rows_of(df)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "BroadcastHashJoin" not in plan
    assert got == expected
