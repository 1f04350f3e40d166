"""Work that grows with the tables: shuffles saved, rows unchanged."""

import datetime as dt

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from conftest import od_row
from odspark.operators import enrich as en
from odspark.operators import forecast as fc
from odspark.operators import lookup as lk
from odspark.operators import reports as rp
from odspark.sources import fixtures as fx

DAILY = "route_name string, stop_id long, direction string, day date, riders long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32KB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")


def odd_days(spark):
    day = dt.date(2024, 1, 1)
    rows = [(r, s, "board", day + dt.timedelta(days=d) if d is not None else None, n)
            for n, (r, s, d) in enumerate((r, s, d) for r in ("A", None) for s in (1, 2, None)
                                          for d in (0, 7, 8, 14, 30, 37, None))]
    rows.append(("A", 9, "board", day, None))
    rows.append(("A", 9, "board", day + dt.timedelta(days=7), 5))
    return spark.createDataFrame(rows, DAILY), spark.sql("SELECT DATE'2024-01-01' AS day")


def test_lags_of_unique_days_need_one_shuffle_and_equal_the_joins(spark):
    d, hol = odd_days(spark)
    once = fc.lag_features(d, hol, key=fc.STOP_KEY, once=True)
    assert plan(once).count("Exchange hashpartitioning(route_name") == 1
    want = fc.lag_features(d, hol, key=fc.STOP_KEY)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, want.select(*once.columns).collect()))


def test_model_inputs_add_no_shuffle_of_the_rows(spark, small_broadcasts):
    d, hol = odd_days(spark)
    x = fc.model_inputs(fc.lag_features(d, hol, key=fc.STOP_KEY, once=True), "2024-01-20")
    assert plan(x).count("Exchange hashpartitioning(route_name") == 1
    assert x.count() == d.count() and x.where("stop_mean IS NULL OR in_lag_7 IS NULL").isEmpty()


def test_rows_in_the_same_bins_are_fitted_as_one(spark):
    day = dt.date(2024, 1, 1)
    d = spark.createDataFrame([(f"R{s % 3}", s, x, day + dt.timedelta(days=k), s * 3 + k % 7)
                               for s in range(12) for x in ("board", "alight") for k in range(30)], DAILY)
    data = fc.model_inputs(fc.lag_features(d, spark.createDataFrame([], "day date"), key=fc.STOP_KEY), "2024-01-25").cache()
    model = fc.fit_inputs(data, 2)
    bins, assembler, _ = model.stages
    train = data.where("split = 'train'")
    alone = GBTRegressor(labelCol="label", maxIter=2, maxBins=fc.BINS, seed=7, predictionCol="by_row").fit(
        assembler.transform(bins.transform(train).select("label", *[(F.col(n) + 0).alias(n) for n in assembler.getInputCols()])))
    got = alone.transform(model.transform(train)).select("predicted", "by_row", F.expr(fc.model_sql(model)).alias("sql"),
                                                         "riders").collect()
    assert fc.model_sql(model).count("CASE WHEN") > 3
    assert all(abs(r.predicted - r.by_row) < 1e-6 and abs(r.sql - r.predicted) < 1e-9 for r in got)
    assert sum(abs(r.predicted - r.riders) for r in got) / len(got) < 3


def test_scores_need_no_window(spark):
    p = spark.createDataFrame([("A", 1, 2.0), ("A", 5, 4.0), ("A", 6, 6.0), ("B", 3, 3.0), ("C", None, 1.0), (None, 2, 1.0),
                               (None, 4, 3.0)], "route_name string, riders long, predicted double")
    s = fc.model_scores(p)
    assert "Window" not in plan(s)
    assert {r.route_name: (r.mae, r.r2, r.n) for r in s.collect()} == {
        "A": (0.6667, 0.8571, 3), "B": (0.0, None, 1), None: (1.0, 0.0, 2)}


def test_pairs_are_added_up_before_names_are_joined(spark):
    tx = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, 7, 9), (None, 2, 5)], "board_stop_id long, alight_stop_id long, riders int")
    stops = spark.createDataFrame([(1, "a", "R", 1), (1, "a", "R", 1), (2, "b", "R", 2)],
                                  "stop_id long, stop_name string, route_name string, stop_seq int")
    assert [(r.riders, r.board_stop, r.alight_stop) for r in rp._pairs(tx, stops).collect()] == [(7, "a", "b")] * 2
    assert [r.riders for r in rp.section_pairs(tx, stops, 1, 9).collect()] == [14]


def test_looked_up_rows_are_not_shuffled(spark, make_od, small_broadcasts):
    od = make_od([od_row(route=f"R{i % 10}", bseq=i) for i in range(3000)])
    out = lk.by_route(od, od.where(F.col("board_seq") % 10 == 3).select("route_name"))
    assert "SortMergeJoin" not in plan(out) and out.count() == 300


def test_codes_are_attached_without_a_shuffle_of_the_target(spark, small_broadcasts):
    side = spark.range(3000).select(*[F.lit(str(i)).alias(n) for i, n in enumerate(
        ["route_name", "route_id", "board_seq", "board_ars", "board_name", "alight_seq", "alight_ars", "alight_name"])])
    out = en.attach_codes(en.normalise_target(side.drop("route_id")), en.normalise_reference(side.drop("route_name")))
    assert "SortMergeJoin" not in plan(out)
    assert out.where("route_id = '1' AND board_code = '3' AND alight_code = '6'").count() == 3000


def test_stored_views_are_not_dealt_to_a_fixed_number_of_tasks(spark, monkeypatch):
    seen = {}

    def written(df, name="stage"):
        seen[name] = plan(df)
        return df
    monkeypatch.setattr(fx, "cut_lineage", written)
    t = fx.Tables(spark, "/root/testdata/sf0.001")
    t.od(), t.tx(), t.daily_stop(), t.daily_od(), t.target_day()
    assert len(seen) >= 5 and not [n for n, p in seen.items() if "RoundRobin" in p and "REBALANCE" not in p]


def test_rows_without_a_day_or_riders_do_not_stop_the_fit(spark):
    d, hol = odd_days(spark)
    p = fc.train_predict_gbt(fc.lag_features(d, hol, key=fc.STOP_KEY, once=True), "2024-01-20", max_iter=1).collect()
    assert len(p) == d.where("day >= DATE '2024-01-20'").count() and all(r.predicted is not None for r in p)
