
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from odspark.operators import congestion as cg
from odspark.operators import correct as cr
from odspark.schema import OD_SCHEMA

ARS = st.sampled_from(["00000", "06137", "01001", "01002", "01003", None])
NAME = st.sampled_from(["S1", "S2", "S3", "가상1", "기점가상2", "경유3", "", None])
SEQ = st.one_of(st.none(), st.integers(min_value=0, max_value=14))
ROW = st.tuples(
    st.sampled_from(["20231017", "20251014"]), st.sampled_from(["R1", "R2"]),
    st.sampled_from([100001, None]), SEQ, ARS, st.sampled_from(["100001001", "277102436", None]), NAME,
    SEQ, ARS, st.sampled_from(["100001002", "277102436", None]), NAME,
    st.integers(min_value=1, max_value=9))

SETTINGS = settings(max_examples=6, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def total(df):
    return df.agg(F.sum("riders")).first()[0] or 0


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=40))
def test_dedup_conserves_and_is_idempotent(spark, rows):
    od = spark.createDataFrame(rows, OD_SCHEMA)
    once = cr.dedup_sum(od)
    assert total(once) == total(od)
    assert rows_of(cr.dedup_sum(once)) == rows_of(once)


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=40))
def test_group1_conserves_riders(spark, rows):
    od = spark.createDataFrame(rows, OD_SCHEMA)
    assert total(cr.fix_virtual_stop(od)) + total(cr.anomaly_rows(od)) == total(od)


@SETTINGS
@given(rows=st.lists(ROW, min_size=1, max_size=40))
def test_chain_and_congestion_partition_invariant(spark, rows):
    od = spark.createDataFrame(rows, OD_SCHEMA)
    assert rows_of(cr.correct_pipeline(od.repartition(1))) == rows_of(cr.correct_pipeline(od.repartition(7)))
    cong_a = rows_of(cg.congestion(od.repartition(1)))
    cong_b = rows_of(cg.congestion(od.repartition(5)))
    assert cong_a == cong_b
    for r in cg.congestion(od).collect():
        assert r.load >= 0 and 0.0 <= r.pct <= 100.0
        if r.max_load and r.max_load > 0 and r.load == r.max_load:
            assert r.pct == 100.0
