"""Forecast feature tables (documented-only work of the original, M1..M10).

All of it is joins and aggregates over daily / trip tables; nothing is
looped per route or per day on the driver. Lags are equi-joins on the
shifted date (a missing day stays missing instead of shifting the series
as ``lag(7)`` over rows would); a table that holds each key and day once
takes them from a window over the days of its key instead.
"""

from __future__ import annotations

from functools import reduce
from math import floor, inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odspark.functions.metrics import pct1
from odspark.session import cut_lineage

c = F.col


def day_type(days: DataFrame, holidays: DataFrame, day_col: str = "day") -> DataFrame:
    """M1: weekday / saturday / sunday / holiday (a holiday wins)."""
    h = holidays.select(c("day").alias("_h")).distinct()
    dow = F.dayofweek(day_col)  # 1 = Sunday, 7 = Saturday
    return (days.join(h, c(day_col) == c("_h"), "left")
            .withColumn("day_type", F.when(c("_h").isNotNull(), "holiday")
                        .when(dow == 7, "saturday").when(dow == 1, "sunday")
                        .otherwise("weekday"))
            .drop("_h"))


ROUTE_KEY = ("route_name",)
STOP_KEY = ("route_name", "stop_id", "direction")


def _known(key):
    """All key columns hold a value: NULL keys match nothing, as in a join."""
    return reduce(lambda x, y: x & y, [c(k).isNotNull() for k in key])


def lag_features(daily: DataFrame, holidays: DataFrame, lags=(7, 30), key=ROUTE_KEY, once: bool = False) -> DataFrame:
    """M2/M3: per key and day the riders with those 7 and 30 days earlier,
    weekday, month and day type. ``key`` is the route, or route, stop and
    direction (boarding or alighting). ``once``: the table has one row per key
    and day, as an aggregate over them does. It is then shuffled once, by key, for
    all lags; otherwise a row joins every row of the earlier day."""
    out = daily
    for k in lags:
        if once:
            earlier = Window.partitionBy(*key).orderBy(F.unix_date("day")).rangeBetween(-k, -k)
            out = out.withColumn(f"lag_{k}", F.when(_known([*key, "day"]), F.max("riders").over(earlier)))
        else:
            past = daily.select(*key, F.date_add(c("day"), k).alias("day"), c("riders").alias(f"lag_{k}"))
            out = out.join(past, [*key, "day"], "left")
    out = out.withColumn("weekday", F.dayofweek("day")).withColumn("month", F.month("day"))
    return day_type(out, holidays)


def temporal_split(df: DataFrame, cut: str, day_col: str = "day") -> DataFrame:
    """M4: 'train' before the cut-off date, 'test' from it on."""
    return df.withColumn("split", F.when(c(day_col) < F.to_date(F.lit(cut)), "train").otherwise("test"))


def naive_predictions(features: DataFrame) -> DataFrame:
    """Seasonal-naive daily prediction (riders a week earlier): the
    deterministic baseline the scores are checked with."""
    return features.withColumn("predicted", c("lag_7").cast("double"))


def model_inputs(features: DataFrame, cut: str, key=STOP_KEY, lags=(7, 30)) -> DataFrame:
    """Numeric inputs of M5 for every row, train and test alike.

    Route and stop enter as their mean riders over the training period (a
    number, so any count of routes and stops fits the trees). A training row's
    own label is left out of its means: the input must not tell the answer. A
    key without other training days takes the route's mean, a route without any
    the mean of all. A missing lag is filled with the mean of the key (of the
    route, of all, in that order) and flagged. Sums and counts of the routes are a
    staged aggregate joined back, so their measured size decides how; those of a key
    are windows over its rows, which lie together for the lags."""
    data = temporal_split(features, cut).withColumn("label", c("riders").cast("double"))
    train = data.where(c("split") == "train")
    held = lambda name: (F.sum("label").alias(f"_{name}_sum"), F.count("label").alias(f"_{name}_n"))
    routes = cut_lineage(train.groupBy("route_name").agg(*held("route")), "route-sums")
    total = routes.agg(F.sum("_route_sum").alias("_all_sum"),
                       F.coalesce(F.sum("_route_n"), F.lit(0)).alias("_all_n")).first()  # one row
    out = data
    if tuple(key) != ROUTE_KEY:
        whole = Window.partitionBy(*key)
        label = F.when((c("split") == "train") & _known(key), c("label"))
        out = out.withColumn("_key_sum", F.sum(label).over(whole)).withColumn("_key_n", F.count(label).over(whole))
    out = out.join(routes, "route_name", "left")
    own = (c("split") == "train") & c("label").isNotNull()
    without = lambda s, n: (s - F.when(own, c("label")).otherwise(0.0)) / F.nullif(
        (n - own.cast("int")).cast("double"), F.lit(0.0))
    overall = without(F.lit(float(total["_all_sum"] or 0.0)), F.lit(total["_all_n"]))
    out = out.withColumn("route_mean", F.coalesce(without(c("_route_sum"), c("_route_n")), overall, F.lit(0.0)))
    of_key = c("route_mean") if tuple(key) == ROUTE_KEY else F.coalesce(without(c("_key_sum"), c("_key_n")), c("route_mean"))
    out = out.withColumn("stop_mean", of_key).drop("_route_sum", "_route_n", "_key_sum", "_key_n")
    for k in lags:
        out = (out.withColumn(f"no_lag_{k}", c(f"lag_{k}").isNull().cast("double"))
               .withColumn(f"in_lag_{k}", F.coalesce(c(f"lag_{k}").cast("double"), c("stop_mean"))))
    kinds = ["weekday", "saturday", "sunday", "holiday"]
    for t in kinds:
        out = out.withColumn(f"is_{t}", (c("day_type") == t).cast("double"))
    if "direction" in out.columns:
        out = out.withColumn("is_alight", (c("direction") == "alight").cast("double"))
    return out


def _inputs_of(data: DataFrame) -> list[str]:
    return ["route_mean", "stop_mean", "weekday", "month",
            *[x for x in data.columns if x.startswith(("in_lag_", "no_lag_", "is_"))]]


BINS = 32  # of an input; Spark's trees tell no more apart


def fit_gbt(features: DataFrame, cut: str, max_iter: int = 20, key=STOP_KEY):
    """M5: gradient-boosted trees fitted to the days before the cut-off (a
    Spark ML pipeline model; training is distributed)."""
    return fit_inputs(cut_lineage(model_inputs(features, cut, key), "model-inputs"), max_iter)


def fit_inputs(data: DataFrame, max_iter: int = 20):
    """``fit_gbt`` over stored ``model_inputs``, which is read twice.

    The means and lags enter as their bins between quantiles of all training
    rows. Trees see nothing else of a row, and the gain of a split and the value
    of a leaf depend on the rows' number and mean label only, so rows that fall
    into the same bins are fitted as one, with their number as its weight. What
    the fit caches is bounded by the distinct bins, not by the rows."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import Bucketizer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = _inputs_of(data)
    wide = [n for n in names if n.endswith("_mean") or n.startswith("in_lag_")]
    train = data.where((c("split") == "train") & c("label").isNotNull())
    cuts = train.approxQuantile(wide, [i / BINS for i in range(1, BINS)], 1 / (16 * BINS))
    bins = Bucketizer(inputCols=wide, outputCols=[f"bin_{n}" for n in wide],
                      splitsArray=[[-inf, *(sorted(set(q)) or [0.0]), inf] for q in cuts])
    seen = [f"bin_{n}" if n in wide else n for n in names]
    assembler = VectorAssembler(inputCols=seen, outputCol="features")
    # the sum drops the mark of a category: bins are ordered numbers
    rows = bins.transform(train).groupBy(*[(c(n) + 0).alias(n) for n in seen]).agg(
        F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    gbt = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, maxBins=BINS,
                       seed=7, predictionCol="predicted")
    return PipelineModel([bins, assembler, gbt.fit(assembler.transform(rows))])


def save_model(model, path: str) -> None:
    """Store a fitted model, in place of one that is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def predict(model, features: DataFrame, cut: str, key=STOP_KEY) -> DataFrame:
    """A prediction for every row of the test period. ``features`` holds the
    training period too: the means that enter the trees come from it."""
    return predict_inputs(model, model_inputs(features, cut, key), key)


def predict_inputs(model, data: DataFrame, key=STOP_KEY) -> DataFrame:
    """``predict`` over stored ``model_inputs``; a row without a day is in no period."""
    return (model.transform(data.where((c("split") == "test") & c("day").isNotNull()))
            .select(*key, "day", "day_type", "riders", "predicted"))


def train_predict_gbt(features: DataFrame, cut: str, max_iter: int = 20, key=STOP_KEY) -> DataFrame:
    """M5: ``fit_gbt`` and ``predict`` in one, over the same stored inputs."""
    data = cut_lineage(model_inputs(features, cut, key), "model-inputs")
    return predict_inputs(fit_inputs(data, max_iter), data, key)


def model_sql(model) -> str:
    """The fitted trees as one SQL expression over the columns of ``model_inputs``.

    It holds for every engine that knows CASE and DOUBLE, so predictions can be
    made, and checked, where no Spark ML is. NULL inputs do not occur there. The
    numbers carry 17 digits, so that each reads back as the same double. A tree
    has at most 2 ** (depth + 1) nodes."""
    bins, assembler, gbt = model.stages
    names = assembler.getInputCols()
    edges = {o: (n, s) for n, o, s in zip(bins.getInputCols(), bins.getOutputCols(), bins.getSplitsArray())}

    def number(x: float) -> str:
        return f"({x:.16e})"

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            return number(n.prediction())
        split = n.split()
        name, at = names[split.featureIndex()], split.threshold()
        # bin i holds the values from its edge i up to, without, edge i + 1
        left = (f"{edges[name][0]} < {number(edges[name][1][floor(at) + 1])}" if name in edges
                else f"{name} <= {number(at)}")
        return f"CASE WHEN {left} THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    return "(" + " + ".join(f"{number(w)} * {node(t._call_java('rootNode'))}"
                            for w, t in zip(gbt.treeWeights, gbt.trees)) + ")"


def model_scores(pred: DataFrame) -> DataFrame:
    """M6: per route MAE and R² over (riders, predicted), 4 decimals."""
    p = pred.where(c("predicted").isNotNull() & c("riders").isNotNull())
    # one aggregate: the squares around the mean are the variance times the rows
    agg = p.groupBy("route_name").agg(
        F.avg(F.abs(c("riders") - c("predicted"))).alias("mae"),
        F.sum((c("riders") - c("predicted")) ** 2).alias("_ss_res"),
        (F.var_pop(c("riders").cast("double")) * F.count(F.lit(1))).alias("_ss_tot"),
        F.count(F.lit(1)).alias("n"))
    return agg.select("route_name", F.round("mae", 4).alias("mae"),
                      F.round(1 - c("_ss_res") / F.nullif(c("_ss_tot"), F.lit(0.0)), 4).alias("r2"), "n")


def hour_ratio(tx: DataFrame, routes: DataFrame) -> DataFrame:
    """M8: share of each hour in a stop's riders, per route, stop and
    direction (boarding at the boarding stop, alighting at the alighting stop)."""
    ends = F.explode(F.array(
        F.struct(c("board_stop_id").alias("stop_id"), F.lit("board").alias("direction")),
        F.struct(c("alight_stop_id").alias("stop_id"), F.lit("alight").alias("direction")))).alias("e")
    agg = (tx.select("route_id", "board_stop_id", "alight_stop_id", "riders", F.hour("board_ts").alias("hour"))
           .join(routes, "route_id").select("route_name", "riders", "hour", ends)
           .groupBy("route_name", "e.stop_id", "e.direction", "hour").agg(F.sum("riders").cast("long").alias("riders")))
    # at most 24 rows per key: the window partition is bounded
    total = F.sum("riders").over(Window.partitionBy("route_name", "stop_id", "direction"))
    return agg.withColumn("ratio", c("riders") / total)


def weight_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """M9: union the new weights and keep the latest version per
    (day_type, hour)."""
    u = current.unionByName(updates)
    w = Window.partitionBy("day_type", "hour").orderBy(c("ver").desc(), c("weight").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where(c("_rn") == 1).drop("_rn")


def hour_split(daily_pred: DataFrame, ratios: DataFrame, weights: DataFrame,
               holidays: DataFrame) -> DataFrame:
    """M7: daily prediction x stop hour ratio x day-type weight (plain
    product; the original does not say how weights are normalised).
    ``daily_pred`` (route_name, stop_id, direction, day, predicted) is split
    over its own stop's hours, whose ratios sum to 1, so the split riders
    before weights sum to the prediction; ``split_riders`` holds them."""
    d = day_type(daily_pred, holidays)
    return (d.join(ratios.drop("riders"), list(STOP_KEY))
            .join(weights.select("day_type", "hour", "weight"), ["day_type", "hour"], "left")
            .withColumn("split_riders", c("predicted") * c("ratio"))
            .withColumn("predicted_riders", c("split_riders") * F.coalesce(c("weight"), F.lit(1.0)))
            .select(*STOP_KEY, "day", "day_type", "hour", "predicted", "ratio", "weight", "split_riders",
                    "predicted_riders"))


def section_share(tx: DataFrame, stops: DataFrame, seq_from: int, seq_to: int,
                  route: str | None = None) -> DataFrame:
    """Riders travelling within a core section of a route as a percent
    of all riders boarding on that route (one route, or every route)."""
    s1 = stops.select(c("stop_id").alias("board_stop_id"), c("route_name").alias("board_route"),
                      c("stop_seq").alias("bseq"))
    s2 = stops.select(c("stop_id").alias("alight_stop_id"), c("stop_seq").alias("aseq"))
    p = tx.join(s1, "board_stop_id").join(s2, "alight_stop_id")
    if route is not None:
        p = p.where(c("board_route") == route)
    inside = c("bseq").between(seq_from, seq_to) & c("aseq").between(seq_from, seq_to)
    agg = p.groupBy("board_route").agg(
        F.sum(F.when(inside, c("riders")).otherwise(0)).cast("long").alias("section_riders"),
        F.sum("riders").cast("long").alias("route_riders"))
    return agg.select(c("board_route").alias("route_name"), "section_riders", "route_riders",
                      pct1("section_riders", "route_riders").alias("section_pct"))
