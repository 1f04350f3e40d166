"""Registered forecast feature queries (M1..M10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odspark.operators import forecast as fc
from odspark.plans.oracle import pct1_sql
from odspark.plans.registry import T, register
from odspark.session import cut_lineage
from odspark.sources.fixtures import oracle_with

CUT = "2000-01-01"
DAYTYPE_SQL = """CASE WHEN h.day IS NOT NULL THEN 'holiday' WHEN dayofweek({d}) = 6 THEN 'saturday'
  WHEN dayofweek({d}) = 0 THEN 'sunday' ELSE 'weekday' END"""


@register("day_type", lambda: oracle_with("daily_od", "holiday") + f"""
SELECT x.day, {DAYTYPE_SQL.format(d='x.day')} AS day_type
FROM (SELECT DISTINCT day FROM daily_od) x LEFT JOIN holiday h ON h.day = x.day""")
def day_type(spark, sf_dir):
    t = T(spark, sf_dir)
    return fc.day_type(t.daily_od().select("day").distinct(), t.holiday())


LAG_SQL = """
SELECT d.day, d.route_name, d.riders, l7.riders AS lag_7, l30.riders AS lag_30,
       CAST(dayofweek(d.day) + 1 AS INTEGER) AS weekday, CAST(month(d.day) AS INTEGER) AS month,
       {dt} AS day_type
FROM daily_od d
LEFT JOIN daily_od l7 ON l7.route_name = d.route_name AND l7.day + INTERVAL 7 DAY = d.day
LEFT JOIN daily_od l30 ON l30.route_name = d.route_name AND l30.day + INTERVAL 30 DAY = d.day
LEFT JOIN holiday h ON h.day = d.day"""


def _lag_cte():
    return "feat AS (" + LAG_SQL.format(dt=DAYTYPE_SQL.format(d="d.day")) + ")"


@register("lag_features", lambda: oracle_with("daily_od", "holiday") + ",\n" + _lag_cte()
          + "\nSELECT * FROM feat")
def lag_features(spark, sf_dir):
    t = T(spark, sf_dir)
    return fc.lag_features(t.daily_od(), t.holiday())


@register("temporal_split", lambda: oracle_with("daily_od", "holiday") + ",\n" + _lag_cte() + f"""
SELECT *, CASE WHEN day < DATE '{CUT}' THEN 'train' ELSE 'test' END AS split FROM feat""")
def temporal_split(spark, sf_dir):
    t = T(spark, sf_dir)
    return fc.temporal_split(fc.lag_features(t.daily_od(), t.holiday()), CUT)


@register("model_scores", lambda: oracle_with("daily_od", "holiday") + ",\n" + _lag_cte() + f""",
p AS (SELECT route_name, riders, CAST(lag_7 AS DOUBLE) AS predicted FROM feat
      WHERE day >= DATE '{CUT}' AND lag_7 IS NOT NULL AND riders IS NOT NULL),
m AS (SELECT p.*, AVG(CAST(riders AS DOUBLE)) OVER (PARTITION BY route_name) AS mean FROM p)
SELECT route_name, round(AVG(abs(riders - predicted)), 4) AS mae,
       round(1 - SUM((riders - predicted) ^ 2) / NULLIF(SUM((riders - mean) ^ 2), 0.0), 4) AS r2,
       COUNT(*) AS n
FROM m GROUP BY route_name""")
def model_scores(spark, sf_dir):
    """M6 on the seasonal-naive predictor over the test period (the GBT of
    M5 is ``forecast.train_predict_gbt``; its scores are not comparable)."""
    t = T(spark, sf_dir)
    feats = fc.temporal_split(fc.lag_features(t.daily_od(), t.holiday()), CUT)
    return fc.model_scores(fc.naive_predictions(feats.where(F.col("split") == "test")))


HOUR_RATIO_SQL = """
SELECT route_name, stop_id, direction, hour, CAST(n AS BIGINT) AS riders,
       n / (SUM(n) OVER (PARTITION BY route_name, stop_id, direction)) AS ratio
FROM (SELECT route_name, stop_id, direction, CAST(hour(board_ts) AS INTEGER) AS hour, SUM(riders) AS n
      FROM (SELECT route_id, board_ts, riders, board_stop_id AS stop_id, 'board' AS direction FROM tx
            UNION ALL SELECT route_id, board_ts, riders, alight_stop_id, 'alight' FROM tx) x
      NATURAL JOIN routes GROUP BY ALL) a"""


@register("hour_ratio", lambda: oracle_with("tx", "routes") + HOUR_RATIO_SQL)
def hour_ratio(spark, sf_dir):
    t = T(spark, sf_dir)
    return fc.hour_ratio(t.tx(), t.routes())


UPSERT_SQL = """
SELECT day_type, hour, weight, ver FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY day_type, hour ORDER BY ver DESC, weight DESC) AS rn
  FROM (SELECT * FROM hour_weight WHERE ver = 1 UNION ALL SELECT * FROM hour_weight WHERE ver = 2) u) r
WHERE rn = 1"""


@register("weight_upsert", lambda: oracle_with("hour_weight") + UPSERT_SQL)
def weight_upsert(spark, sf_dir):
    hw = T(spark, sf_dir).hour_weight()
    return fc.weight_upsert(hw.where(F.col("ver") == 1), hw.where(F.col("ver") == 2))


def _hour_split_sql():
    # the prediction is spread by the stop's riders per hour over its riders of the day
    return oracle_with("daily_stop", "holiday", "tx", "routes", "hour_weight") + f""",
hr AS ({HOUR_RATIO_SQL}),
w AS ({UPSERT_SQL}),
whole AS (SELECT route_name, stop_id, direction, SUM(riders) AS n FROM hr GROUP BY ALL),
want AS (SELECT d.route_name, d.stop_id, d.direction, d.day, {DAYTYPE_SQL.format(d='d.day')} AS day_type,
                CAST(COALESCE(past.riders, m.mean) AS DOUBLE) AS predicted
         FROM daily_stop d
         LEFT JOIN daily_stop past ON past.route_name = d.route_name AND past.stop_id = d.stop_id
              AND past.direction = d.direction AND past.day = d.day - INTERVAL 7 DAY
         JOIN (SELECT route_name, stop_id, direction, AVG(riders) AS mean FROM daily_stop GROUP BY ALL) m
              ON m.route_name = d.route_name AND m.stop_id = d.stop_id AND m.direction = d.direction
         LEFT JOIN holiday h ON h.day = d.day)
SELECT route_name, stop_id, direction, day, want.day_type, hour, predicted, hr.riders / whole.n AS ratio, weight,
       predicted * (hr.riders / whole.n) AS split_riders,
       predicted * (hr.riders / whole.n) * COALESCE(weight, 1.0) AS predicted_riders
FROM want JOIN hr USING (route_name, stop_id, direction) JOIN whole USING (route_name, stop_id, direction)
LEFT JOIN w USING (day_type, hour)"""


def _stop_features(t):
    return fc.lag_features(t.daily_stop(), t.holiday(), key=fc.STOP_KEY, once=True)


def _naive_by_stop(t):
    """Riders of the week before, or the stop's mean where that day is missing."""
    mean = F.avg("riders").over(Window.partitionBy(*fc.STOP_KEY))
    return (_stop_features(t).dropna(subset=list(fc.STOP_KEY))
            .withColumn("predicted", F.coalesce(F.col("lag_7").cast("double"), mean)))


@register("hour_split", _hour_split_sql)
def hour_split(spark, sf_dir):
    """M7 for every stop, direction and day of the table: the seasonal-naive
    prediction split over the stop's hours."""
    t = T(spark, sf_dir)
    hw = t.hour_weight()
    weights = fc.weight_upsert(hw.where(F.col("ver") == 1), hw.where(F.col("ver") == 2))
    daily = _naive_by_stop(t).select(*fc.STOP_KEY, "day", "predicted")
    return fc.hour_split(daily, fc.hour_ratio(t.tx(), t.routes()), weights, t.holiday())


SECTION_FROM, SECTION_TO = 1, 41


@register("section_share", lambda: oracle_with("tx", "stops") + f"""
SELECT route_name, section_riders, route_riders,
       CAST({pct1_sql('section_riders', 'route_riders')} AS DOUBLE) AS section_pct
FROM (SELECT s1.route_name,
        CAST(SUM(CASE WHEN s1.stop_seq BETWEEN {SECTION_FROM} AND {SECTION_TO}
                       AND s2.stop_seq BETWEEN {SECTION_FROM} AND {SECTION_TO} THEN t.riders ELSE 0 END) AS BIGINT)
          AS section_riders,
        CAST(SUM(t.riders) AS BIGINT) AS route_riders
      FROM tx t JOIN stops s1 ON t.board_stop_id = s1.stop_id JOIN stops s2 ON t.alight_stop_id = s2.stop_id
      GROUP BY s1.route_name) a""")
def section_share(spark, sf_dir):
    """M10 for every route: riders inside the core section (seqs 1..41)."""
    t = T(spark, sf_dir)
    return fc.section_share(t.tx(), t.stops(), SECTION_FROM, SECTION_TO)


def _with_daily_stop(*names):
    """The stop table is read three times: computed once."""
    return oracle_with("daily_stop", *names).replace("daily_stop AS (", "daily_stop AS MATERIALIZED (")


@register("stop_lag_features", lambda: _with_daily_stop("holiday") + f"""
SELECT d.*, a.riders AS lag_7, b.riders AS lag_30, CAST(dayofweek(d.day) + 1 AS INTEGER) AS weekday,
       CAST(month(d.day) AS INTEGER) AS month, {DAYTYPE_SQL.format(d='d.day')} AS day_type
FROM daily_stop d LEFT JOIN holiday h ON h.day = d.day
LEFT JOIN daily_stop a ON (a.route_name = d.route_name AND a.stop_id = d.stop_id AND a.direction = d.direction
                           AND a.day = d.day - INTERVAL 7 DAY)
LEFT JOIN daily_stop b ON (b.route_name = d.route_name AND b.stop_id = d.stop_id AND b.direction = d.direction
                           AND b.day = d.day - INTERVAL 30 DAY)""")
def stop_lag_features(spark, sf_dir):
    """M3 at the stop grain, boarding and alighting."""
    return _stop_features(T(spark, sf_dir))


@register("model_inputs", lambda: _with_daily_stop() + f""", f AS MATERIALIZED (
SELECT d.*, a.riders AS lag_7, b.riders AS lag_30, CASE WHEN d.day < DATE '{CUT}' THEN 1 ELSE 0 END AS own
FROM daily_stop d
LEFT JOIN daily_stop a ON (a.route_name = d.route_name AND a.stop_id = d.stop_id AND a.direction = d.direction
                           AND a.day = d.day - INTERVAL 7 DAY)
LEFT JOIN daily_stop b ON (b.route_name = d.route_name AND b.stop_id = d.stop_id AND b.direction = d.direction
                           AND b.day = d.day - INTERVAL 30 DAY)),
k AS (SELECT route_name, stop_id, direction, CAST(SUM(riders) AS DOUBLE) AS s, COUNT(*) AS n FROM f WHERE own = 1 GROUP BY ALL),
r AS (SELECT route_name, SUM(s) AS s, SUM(n) AS n FROM k GROUP BY route_name),
o AS (SELECT SUM(s) AS s, SUM(n) AS n FROM r),
m AS (SELECT f.*, COALESCE((r.s - own * riders) / CAST(NULLIF(r.n - own, 0) AS DOUBLE),
                           (o.s - own * riders) / CAST(NULLIF(o.n - own, 0) AS DOUBLE), 0.0) AS route_mean,
             (k.s - own * riders) / CAST(NULLIF(k.n - own, 0) AS DOUBLE) AS key_mean
      FROM f CROSS JOIN o LEFT JOIN r USING (route_name) LEFT JOIN k USING (route_name, stop_id, direction))
SELECT route_name, stop_id, direction, day, route_mean, COALESCE(key_mean, route_mean) AS stop_mean,
  COALESCE(CAST(lag_7 AS DOUBLE), key_mean, route_mean) AS in_lag_7,
  COALESCE(CAST(lag_30 AS DOUBLE), key_mean, route_mean) AS in_lag_30 FROM m""")
def model_inputs(spark, sf_dir):
    """M3: the means and filled lags that M5 learns from, each training row's own label left out."""
    x = fc.model_inputs(_stop_features(T(spark, sf_dir)), CUT)
    return x.select(*fc.STOP_KEY, "day", "route_mean", "stop_mean", "in_lag_7", "in_lag_30")


MODEL_ROUNDS = 5


@register("model_predictions", lambda: oracle_with("daily_stop") + f"""
SELECT route_name, stop_id, direction, day, riders, TRUE AS predicted
FROM daily_stop WHERE day >= DATE '{CUT}'""")
def model_predictions(spark, sf_dir):
    """M5: gradient-boosted trees trained on the days before the cut-off, for every stop,
    direction and day from it on. The trees are fitted at run time, so no fixed SQL can hold
    their values; ``predicted`` says that the number is there and equals the trees' exported
    SQL over the inputs of ``model_inputs``, which the oracle does recompute. A test
    evaluates that SQL in another engine and compares every prediction and score."""
    data = cut_lineage(fc.model_inputs(_stop_features(T(spark, sf_dir)), CUT), "model-inputs")
    model = fc.fit_inputs(data, MODEL_ROUNDS)
    p = model.transform(data.where((F.col("split") == "test") & F.col("day").isNotNull()))
    same = F.abs(F.col("predicted") - F.expr(fc.model_sql(model))) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("predicted"))
    return p.select(*fc.STOP_KEY, "day", "riders", F.coalesce(same, F.lit(False)).alias("predicted"))


@register("model_scores_gbt", lambda: oracle_with("daily_stop") + f"""
SELECT route_name, COUNT(*) AS n, TRUE AS has_mae FROM daily_stop WHERE day >= DATE '{CUT}' GROUP BY route_name""")
def model_scores_gbt(spark, sf_dir):
    """M6 on M5: rows scored per route (the values are compared in a test)."""
    s = fc.model_scores(fc.train_predict_gbt(_stop_features(T(spark, sf_dir)), CUT, max_iter=MODEL_ROUNDS))
    return s.select("route_name", "n", F.col("mae").isNotNull().alias("has_mae"))
