"""Forecast chain: every row predicted, riders conserved, many routes."""

import datetime as dt

from pyspark.sql import functions as F

from odspark.operators import forecast as fc


def daily(spark, routes, days=24, gap=5):
    rows = []
    for r in range(routes):
        for d in range(days):
            if (r + d) % gap:
                day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
                rows += [(f"R{r}", r * 10 + s, x, day, (r + 1) * (s + 2) + d % 7) for s in (1, 2) for x in ("board", "alight")]
    return spark.createDataFrame(rows, "route_name string, stop_id long, direction string, day date, riders long")


def test_forty_routes_and_missing_lags_are_all_predicted(spark):
    d = daily(spark, 40)
    hol = spark.createDataFrame([(dt.date(2024, 1, 1),)], "day date")
    features = fc.lag_features(d, hol, key=fc.STOP_KEY)
    p = fc.train_predict_gbt(features, "2024-01-15", max_iter=2).collect()
    want = d.where(F.col("day") >= F.lit("2024-01-15").cast("date")).count()
    assert len(p) == want and all(r.predicted is not None for r in p)


def inputs(spark, rows):
    d = spark.createDataFrame([(r, s, "board", dt.date(2024, m, k), n) for r, s, m, k, n in rows],
                              "route_name string, stop_id long, direction string, day date, riders long")
    hol = spark.createDataFrame([], "day date")
    x = fc.model_inputs(fc.lag_features(d, hol, key=fc.STOP_KEY), "2024-01-15").collect()
    return {(r.route_name, r.stop_id, r.day.month, r.day.day): r for r in x}


def test_no_training_rows_of_a_stop_fall_back_to_route_and_all(spark):
    x = inputs(spark, [("A", 1, 1, 1, 4), ("A", 2, 2, 1, 9), ("B", 3, 2, 1, 7)])
    assert {k[:2]: r.stop_mean for k, r in x.items() if k[2] == 2} == {("A", 2): 4.0, ("B", 3): 4.0}
    assert all(r.in_lag_7 == 4.0 and r.no_lag_7 == 1.0 for k, r in x.items() if k[2] == 2)
    assert x["A", 1, 1, 1].stop_mean == 0.0  # nothing but its own label


def test_a_training_row_does_not_see_its_own_label(spark):
    x = inputs(spark, [("A", 1, 1, 1, 100), ("A", 2, 1, 1, 4), ("A", 2, 1, 2, 8), ("A", 2, 2, 1, 5), ("A", 1, 2, 1, 5),
                       ("B", 7, 1, 3, 50)])
    one = x["A", 1, 1, 1]  # a stop with one training day takes the route's mean of the other rows
    assert one.route_mean == one.stop_mean == one.in_lag_7 == 6.0
    assert (x["A", 2, 1, 1].stop_mean, x["A", 2, 1, 2].stop_mean) == (8.0, 4.0)
    assert x["A", 2, 1, 1].route_mean == 54.0
    assert (x["B", 7, 1, 3].stop_mean, x["B", 7, 1, 3].route_mean) == (112 / 3, 112 / 3)
    # rows of the test period are not in the means and see them whole
    assert x["A", 2, 2, 1].stop_mean == 6.0 and x["A", 1, 2, 1].stop_mean == 100.0 and x["A", 1, 2, 1].route_mean == 112 / 3


def test_hour_split_conserves_riders(spark):
    import __spark_entry__ as E
    out = E.queries()["hour_split"](spark, "/root/testdata/sf0.001")
    bad = (out.groupBy(*fc.STOP_KEY, "day").agg(F.sum("split_riders").alias("s"), F.first("predicted").alias("p"))
           .where(F.abs(F.col("s") - F.col("p")) > 1e-6))
    assert bad.count() == 0
    assert out.select("day").distinct().count() > 100


def test_predictions_and_scores_recomputed_by_another_engine(spark, tmpdir_path):
    """The inputs come from DuckDB's own SQL, the trees from the exported expression:
    every prediction, MAE and R2 is compared as a number. A reloaded model is the same."""
    from odspark.plans import registry
    from odspark.plans.queries_forecast import CUT
    from odspark.plans.registry import T
    from oracle_harness import duck
    sf = "/root/testdata/sf0.001"
    t = T(spark, sf)
    features = fc.lag_features(t.daily_stop(), t.holiday(), key=fc.STOP_KEY)
    model = fc.fit_gbt(features, CUT, max_iter=4)
    sql = fc.model_sql(model)
    fc.save_model(model, f"{tmpdir_path}/model")
    fc.save_model(model, f"{tmpdir_path}/model")  # again, in place
    again = fc.load_model(f"{tmpdir_path}/model")
    assert fc.model_sql(again) == sql and sql.count("CASE WHEN") > 20

    pred = fc.predict(again, features, CUT).cache()
    got = {tuple(r[k] for k in (*fc.STOP_KEY, "day")): r for r in pred.collect()}
    oracle, con = registry.oracle_sql(), duck(sf)
    kinds = ", ".join(f"CASE WHEN day_type = '{k}' THEN 1.0 ELSE 0.0 END AS is_{k}"
                      for k in ("weekday", "saturday", "sunday", "holiday"))
    con.execute(f"CREATE TABLE i AS {oracle['model_inputs']}")
    con.execute(f"CREATE TABLE f AS {oracle['stop_lag_features']}")
    con.execute(f"""CREATE TABLE p AS SELECT *, {sql} AS predicted FROM (
      SELECT i.*, riders, weekday, month, CASE WHEN lag_7 IS NULL THEN 1.0 ELSE 0.0 END AS no_lag_7,
             CASE WHEN lag_30 IS NULL THEN 1.0 ELSE 0.0 END AS no_lag_30, {kinds},
             CASE WHEN direction = 'alight' THEN 1.0 ELSE 0.0 END AS is_alight
      FROM i JOIN f USING (route_name, stop_id, direction, day) WHERE day >= DATE '{CUT}') x""")
    want = con.sql("SELECT route_name, stop_id, direction, day, riders, predicted FROM p").fetchall()
    assert len(want) == len(got) > 1000 and len({round(w[-1], 6) for w in want}) > 5
    for *k, riders, value in want:
        r = got[tuple(k)]
        assert r.riders == riders and abs(r.predicted - value) <= 1e-9 * max(1.0, abs(value)), k
    scores = {r.route_name: r for r in fc.model_scores(pred).collect()}
    rows = con.sql("""SELECT route_name, AVG(ABS(riders - predicted)), COUNT(*),
      1 - SUM((riders - predicted) ^ 2) / NULLIF(SUM((riders - m) ^ 2), 0.0)
      FROM (SELECT *, AVG(CAST(riders AS DOUBLE)) OVER (PARTITION BY route_name) AS m FROM p) x GROUP BY route_name""").fetchall()
    assert len(rows) == len(scores) > 1
    for route, mae, n, r2 in rows:
        s = scores[route]
        assert s.n == n and abs(s.mae - mae) < 1e-4 and abs(s.r2 - r2) < 1e-4
