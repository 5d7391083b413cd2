"""Half-hour demand forecast and stock verdict."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dockflow.functions import calendar as cal
from dockflow.functions import service
from dockflow.functions.flows import activity, occupancy
from dockflow.operators.forest import ForestRegressor
from dockflow.operators.keys import null_safe_join
from dockflow.operators.layout import spread
from dockflow.operators.ranking import row_index
from dockflow.plans.clusters import with_cluster
from dockflow.schemas import HALF_HOURS, SEASONS, WEEKDAYS

SEED = 3482
TREES = 200
DEPTH = 30  # the most that the forest allows: leaves are bounded by their rows
CLUSTERS = ["1", "2", "3", "4"]
CATEGORIES = {"weekday": WEEKDAYS, "time": HALF_HOURS, "cluster": CLUSTERS, "season": SEASONS}
NUMBERS = ["prev_bike_num", "latitude", "longitude"]


def station_sample(
    panel: DataFrame, clusters: DataFrame, per_cluster: int = 3, seed: int = SEED
) -> DataFrame:
    """Per cluster the most and least active stations and a few others.

    The others are drawn by a hash of seed and station, so the draw does not
    depend on how the data is partitioned.  Ties at top and bottom are kept.
    """
    per = with_cluster(
        panel.groupBy("number").agg(F.sum(activity()).alias("tot_act")), clusters
    )
    ends = per.groupBy("cluster").agg(F.max("tot_act").alias("_hi"), F.min("tot_act").alias("_lo"))
    judged = null_safe_join(per, ends, ["cluster"])
    top, bottom = F.col("tot_act") == F.col("_hi"), F.col("tot_act") == F.col("_lo")
    picks = F.array_compact(
        F.array(F.when(top, F.lit("top")), F.when(bottom, F.lit("bottom")))
    )
    chosen = judged.select("number", "cluster", F.explode(picks).alias("pick"))
    rest = judged.where(~top & ~bottom & F.col("cluster").isin(*CLUSTERS))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("number").cast("string")))
    seat = F.row_number().over(W.partitionBy("cluster").orderBy(draw, "number"))
    others = rest.withColumn("_seat", seat).where(F.col("_seat") <= per_cluster)
    return chosen.unionByName(others.select("number", "cluster", F.lit("sample").alias("pick")))


def half_hour_features(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rounded mean bikes per half hour and the bikes of the half hour before.

    The previous value is looked up inside one day: at most 48 rows.
    """
    day = ["number", "name", "address", "bike_stands", "date"]
    # the cluster joins the rolled-up rows: it depends on the station alone
    rolled = (
        panel.groupBy(*day, "weekday", cal.half_hour_text(F.col("slot")).alias("time"))
        .agg(F.bround(F.avg(occupancy())).alias("av_bikes"))
        .withColumn("season", cal.season(F.col("date")))
    )
    before = F.lag("av_bikes").over(W.partitionBy(*day).orderBy("time"))
    lagged = rolled.withColumn("prev_bike_num", F.coalesce(before, F.col("av_bikes")))
    return with_cluster(lagged, clusters)


def with_place(features: DataFrame, stations: DataFrame) -> DataFrame:
    return features.join(stations.select("number", "latitude", "longitude"), "number", "left")


FEATURE_ORDER = ["name", "address", "bike_stands", "date", "season", "weekday", "time"]


def positional_split(features: DataFrame) -> DataFrame:
    """Adds ``split``: rows 7n+1 to 10n (n = rows div 10) are test, others train.

    Rows are in station order, so the test rows are mostly unseen stations.
    """
    indexed = row_index(features, "number", FEATURE_ORDER)
    n = F.floor(F.col("row_count") / F.lit(10))
    test = (F.col("row_index") >= 7 * n + 1) & (F.col("row_index") <= 10 * n)
    return indexed.withColumn("split", F.when(test, "test").otherwise("train")).drop("row_count")


def time_split(features: DataFrame, first_test_day: str) -> DataFrame:
    test = F.col("date") >= F.lit(first_test_day).cast("date")
    return features.withColumn("split", F.when(test, "test").otherwise("train"))


def held_out_metrics(scored: DataFrame) -> DataFrame:
    """Errors of the test rows before and after rounding the prediction."""
    actual, pred = F.col("av_bikes"), F.col("pred")
    return scored.agg(
        service.rmsle(actual, pred).alias("rmsle_raw"),
        service.rmse(actual, pred).alias("rmse_raw"),
        service.rmse(actual, F.bround(pred)).alias("rmse_rounded"),
    )


def unseen_metrics(scored: DataFrame) -> DataFrame:
    """RMSE before rounding; RMSLE after rounding and taking |actual|."""
    actual, pred = F.col("av_bikes"), F.col("pred")
    return scored.agg(
        service.rmse(actual, pred).alias("rmse_raw"),
        service.rmsle(F.abs(actual), F.bround(pred)).alias("rmsle_rounded"),
    )


def rounded(scored: DataFrame) -> DataFrame:
    return scored.withColumns({"pred": F.bround("pred"), "av_bikes": F.abs("av_bikes")})


def error_column(of_rounded: bool = False) -> Column:
    """RMSE of the raw predictions (unseen rows) or the rounded ones (held-out rows)."""
    return service.rmse(F.col("av_bikes"), F.bround("pred") if of_rounded else F.col("pred"))


def error_of(scored: DataFrame, of_rounded: bool = False) -> Column:
    """The error as a one-value subquery."""
    return scored.agg(error_column(of_rounded)).scalar()


def with_band(scored: DataFrame, of_rounded: bool = False) -> DataFrame:
    """Rounded predictions with the error band around them."""
    shown = rounded(scored).withColumn("error", error_of(scored, of_rounded))
    pred, error = F.col("pred"), F.col("error")
    return shown.withColumns(
        {"up_bound": service.upper_band(pred, error), "low_bound": service.lower_band(pred, error)}
    )


def stock_verdicts(scored: DataFrame, weekday: str = "Mon", time: str = "08:00") -> DataFrame:
    """Verdict, gap size and id range of each station at one moment of the week."""
    shown = with_band(scored).where((F.col("weekday") == weekday) & (F.col("time") == time))
    actual, low, high = F.col("av_bikes"), F.col("low_bound"), F.col("up_bound")
    judged = shown.withColumn("acc_pred", service.verdict(actual, low, high))
    return judged.withColumns(
        {
            "gap": service.gap_size(F.col("acc_pred"), actual, low, high),
            "st_range": service.station_range(F.col("number")),
        }
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("st_range", "acc_pred").agg(F.count(F.lit(1)).alias("stations"))


def forecast_curves(scored: DataFrame, by_weekday: bool = False) -> DataFrame:
    """Mean actual and predicted bikes and capacity per station and half hour."""
    keys = ["address", "weekday", "time"] if by_weekday else ["number", "address", "time"]
    return scored.withColumn("pred", F.bround("pred")).groupBy(*keys).agg(
        F.avg("av_bikes").alias("mean_av_bikes"),
        F.avg("pred").alias("mean_pred"),
        F.max("bike_stands").alias("tot_stands"),
    )


def curves_with_band(scored: DataFrame, by_weekday: bool = False, of_rounded: bool = True) -> DataFrame:
    """The mean curves with the error band around the predicted one."""
    curves = forecast_curves(scored, by_weekday).withColumn("error", error_of(scored, of_rounded))
    pred, error = F.col("mean_pred"), F.col("error")
    return curves.withColumns({"up_bound": pred + error, "low_bound": pred - error})


def error_labels(scored: DataFrame, of_rounded: bool = False) -> DataFrame:
    per = scored.agg(error_column(of_rounded).alias("error"))
    return per.select(
        service.error_label(F.col("error")).alias("label"),
        service.error_range_label(F.col("error")).alias("range_label"),
    )


def full_hours(features: DataFrame) -> DataFrame:
    return features.where(cal.is_full_hour(F.col("time"))).select("time").distinct()


def complete_rows(features: DataFrame) -> DataFrame:
    """Rows the forest can use: coordinates and previous value present."""
    return features.dropna(subset=[*NUMBERS, "av_bikes"])


def forest_pipeline(trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Pipeline:
    """Indexers with fixed levels (no fitting pass), assembler, forest.

    A level outside the fixed ones gets its own bucket.  Trees grow until a leaf
    would hold fewer than five rows, and try two of the seven predictors at a split.
    """
    indexers = [
        StringIndexerModel.from_labels(
            levels, inputCol=name, outputCol=f"{name}_ix", handleInvalid="keep"
        )
        for name, levels in CATEGORIES.items()
    ]
    assembler = VectorAssembler(
        inputCols=[f"{name}_ix" for name in CATEGORIES] + NUMBERS, outputCol="features"
    )
    forest = ForestRegressor(
        features="features",
        label="av_bikes",
        prediction="pred",
        trees=trees,
        depth=depth,
        bins=256,
        least=5,
        tried=2,
        seed=seed,
    )
    return Pipeline(stages=[*indexers, assembler, forest])


def fit_forest(train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """Fits on cached rows, spread evenly and sorted so that a fit can be repeated."""
    columns = ["av_bikes", *CATEGORIES, *NUMBERS]
    used = spread(complete_rows(train).select(*columns), *columns)
    used = used.sortWithinPartitions(*columns).persist()
    try:
        return forest_pipeline(trees, depth, seed).fit(used)
    finally:
        used.unpersist()


def scored_rows(model: PipelineModel, features: DataFrame) -> DataFrame:
    """All rows with a prediction; NULL where a predictor is missing."""
    known = F.lit(True)
    for name in NUMBERS:
        known = known & F.col(name).isNotNull()
    scored = model.transform(features.where(known)).select(*features.columns, "pred")
    missing = features.where(~known).withColumn("pred", F.lit(None).cast("double"))
    return scored.unionByName(missing)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def impurity_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance); seven numbers of the fitted model."""
    values = model.stages[-1].featureImportances.toArray()
    names = [*CATEGORIES, *NUMBERS]
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    )


def permutation_importance(model: PipelineModel, scored_rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Rise of the mean squared error when one feature's values are shuffled.

    Rows get a position, and a second position by a hash of the first; joining
    the two deals every row the feature values of another one.  Both positions
    are running counts per key, so no task sorts the whole table.
    """
    names = [*CATEGORIES, *NUMBERS]
    rows = row_index(complete_rows(scored_rows), "number", FEATURE_ORDER).select(
        "row_index", "av_bikes", *names
    )
    bucket = F.pmod(F.xxhash64("row_index", F.lit(seed)), F.lit(1 << 20)).cast("int")
    dealt = row_index(
        rows.withColumn("_bucket", bucket).withColumnRenamed("row_index", "_own"), "_bucket", ["_own"]
    )
    partner = dealt.select("row_index", *[F.col(n).alias(f"_other_{n}") for n in names])
    paired = rows.join(partner, "row_index")

    def variant(mixed: str | None) -> Column:
        values = [F.col(f"_other_{n}" if n == mixed else n).alias(n) for n in names]
        return F.struct(F.lit(mixed or "").alias("feature"), "av_bikes", *values)

    # all variants of a row go through the model in one pass
    variants = paired.select(F.explode(F.array(*[variant(n) for n in [None, *names]])).alias("v"))
    mse = F.avg(service.squared_error(F.col("av_bikes"), F.col("pred"))).alias("mse")
    errors = model.transform(variants.select("v.*")).groupBy("feature").agg(mse)
    base = F.max(F.when(F.col("feature") == "", F.col("mse"))).over(W.partitionBy(F.lit(0)))
    return errors.withColumn("increase", F.col("mse") - base).where(F.col("feature") != "")


def as_rows(metrics: DataFrame, rows: str) -> DataFrame:
    """One-row metrics as (rows, metric, value)."""
    return metrics.unpivot([], metrics.columns, "metric", "value").withColumn("rows", F.lit(rows))
