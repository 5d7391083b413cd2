"""Scaling, k-means on profiles or flows, and the station's nearest centre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dockflow.functions import calendar as cal
from dockflow.plans import explore, profiles
from dockflow.schemas import CENTRES, DAY_SLOTS

K = 4
SEED = 3482
ROUNDS = 200  # at most; a fit ends when no centre moves


def column_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance and range per column, one row each, in one pass."""
    stats = df.agg(
        *[F.var_samp(c).alias(f"v_{c}") for c in columns],
        *[(F.max(c) - F.min(c)).cast("double").alias(f"r_{c}") for c in columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"v_{c}").alias("variance"),
            F.col(f"r_{c}").alias("range"),
        )
        for c in columns
    ]
    return stats.select(F.inline(F.array(*rows)))


def range_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by their range; nothing is shifted."""
    ranges = df.agg(F.struct(*[(F.max(c) - F.min(c)).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.try_divide(F.col(c), ranges[c]) for c in columns})


def zscored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    return df.withColumns(
        {c: F.try_divide(F.col(c) - stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns}
    )


def total_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Within-cluster sum of squares for one cluster: (n-1) times the variances."""
    spread: Column = F.lit(0.0)
    for c in columns:
        spread = spread + F.var_samp(c)
    return df.agg(((F.count(F.lit(1)) - 1) * spread).alias("wss")).select(
        F.lit(1).alias("k"), "wss"
    )


def total_spread_long(long: DataFrame) -> DataFrame:
    """The same from the long profile: per-slot variances, no wide table."""
    per = long.groupBy("slot").agg(
        F.var_samp("available_stands").alias("v"), F.count(F.lit(1)).alias("n")
    )
    return per.agg(((F.max("n") - 1) * F.sum("v")).alias("wss")).select(F.lit(1).alias("k"), "wss")


def kmeans(k: int, seed: int = SEED) -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")


def fit_kmeans(points: DataFrame, k: int = K, seed: int = SEED) -> KMeansModel:
    """Fits on cached points until no centre moves: the fit reads its input more
    than once, and each centre ends as the mean of its rows."""
    used = points.select("features").persist()
    try:
        return kmeans(k, seed).setMaxIter(ROUNDS).setTol(0.0).fit(used)
    finally:
        used.unpersist()


def fit_facts(assigned: DataFrame, centres: Sequence[Sequence[float]], near: float = 1e-9) -> DataFrame:
    """What a k-means fit must satisfy, recomputed from the published centres.

    ``assigned``: features and cluster of every row.  One row: ``rows``, ``groups``
    (with a row), ``misplaced`` (rows to which another centre is nearer),
    ``shifted`` (centres that are not the mean of their rows), ``within`` (sum of
    squared distances to the own centre) and ``between`` (of the rows' centres to
    the mean of all).  A right fit has no row misplaced and no centre shifted, and
    within + between is the total spread.  The centres are k x dims numbers.
    """
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in centre]) for centre in centres])
    square = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    rows = assigned.select(vector_to_array("features").alias("_x"), F.col("cluster").alias("_c"), listed.alias("_centres"))
    rows = rows.withColumn("_d", F.transform("_centres", lambda c: square(F.col("_x"), c)))
    own = F.get("_d", F.col("_c"))
    per = rows.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce((own > F.array_min("_d") + near * (1 + own)).cast("long"), F.lit(1))).alias("misplaced"),
        F.sum(own).alias("within"),
        F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(len(centres[0]))]).alias("mean"),
    )
    whole = per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum("misplaced").alias("misplaced"), F.sum("within").alias("within"),
        F.array(*[F.sum(F.col("n") * F.get("mean", F.lit(i))) / F.sum("n") for i in range(len(centres[0]))]).alias("_mean"),
        F.collect_list(F.struct("_c", "n", "mean")).alias("_groups"),  # k of them
    )
    centre = lambda g: F.get(listed, g["_c"])
    off = F.filter("_groups", lambda g: F.coalesce(square(g["mean"], centre(g)) > near * (1 + square(g["mean"], F.col("_mean"))), F.lit(True)))
    between = F.aggregate("_groups", F.lit(0.0), lambda s, g: s + g["n"] * square(centre(g), F.col("_mean")))
    return whole.select("rows", "groups", "misplaced", F.size(off).cast("long").alias("shifted"), "within", between.alias("between"))


def fit_with_cost(cached: DataFrame, k: int, seed: int = SEED) -> tuple[KMeansModel, float]:
    """A fit until no centre moves, and the squared distances to its centres.

    The cost that a fit states is that of the centres before its last round, so it
    only holds if that round moved none; else it is summed over the rows.
    """
    model = kmeans(k, seed).setMaxIter(ROUNDS).setTol(0.0).fit(cached)
    if model.summary.numIter < ROUNDS:
        return model, float(model.summary.trainingCost)
    return model, float(fit_facts(model.transform(cached), [c.tolist() for c in model.clusterCenters()]).first()["within"])


def elbow(points: DataFrame, ks: Sequence[int], seed: int = SEED) -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares); the points are cached for the fits."""
    cached = points.select("features").persist()
    try:
        return [(k, fit_with_cost(cached, k, seed)[1]) for k in ks]
    finally:
        cached.unpersist()


def elbow_frame(spark: SparkSession, points: DataFrame, ks: Sequence[int], seed: int = SEED) -> DataFrame:
    return spark.createDataFrame(elbow(points, ks, seed), "k int, wss double")


def flow_points(panel: DataFrame, columns: Sequence[str] = ("check_in", "check_out")) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(panel)


def subset(panel: DataFrame, weekdays: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Rows of some weekdays, and of the most (n) or least (-n) active stations."""
    chosen = panel
    if weekdays is not None:
        chosen = profiles.on_weekdays(chosen, weekdays)
    if top is not None:
        chosen = explore.rows_of(chosen, explore.top_by_activity(panel, top, "number"), "number")
    return chosen


def profile_points(
    panel: DataFrame, weekdays: Sequence[str] | None = None, top: int | None = None
) -> DataFrame:
    """Filled profile vectors of all stations or a subset.

    ``weekdays`` restricts the days; ``top`` to the most (n) or least (-n)
    active stations.  The gap fill runs after the restriction.
    """
    return profiles.vectors(profiles.filled_days(subset(panel, weekdays, top)))


def centres_frame(spark: SparkSession, model: KMeansModel, slots: Sequence[int] = tuple(DAY_SLOTS)) -> DataFrame:
    """Centres of a profile model: cluster (from 1), slot, available_stands.

    ``slots`` names the slots of the fitted vectors, if some are missing in all rows.
    k x 144 numbers: model parameters, already on the driver.
    """
    rows = [
        (i + 1, slot, float(x))
        for i, centre in enumerate(model.clusterCenters())
        for slot, x in zip(slots, centre, strict=True)
    ]
    return spark.createDataFrame(rows, CENTRES)


def centre_curves(centres: DataFrame) -> DataFrame:
    return centres.withColumn("time", cal.time_text(F.col("slot")))


def nearest_centre(panel: DataFrame, centres: DataFrame) -> DataFrame:
    """(number, name, cluster): the centre whose slot total is nearest.

    The k centre totals travel as one array value, so each station is compared
    inside its own row.  A tie goes to the lowest cluster id.
    """
    totals = centres.groupBy("cluster").agg(F.sum("available_stands").alias("total"))
    listed = totals.agg(F.collect_list(F.struct("cluster", "total"))).scalar()
    # the total is per number over all its names, of which a station has few
    names = profiles.station_profile(panel).groupBy("number", "name").agg(F.sum("stands").alias("_part"))
    stations = names.withColumns(
        {"_total": F.sum("_part").over(W.partitionBy("number")), "_centres": listed}
    )
    distance = F.transform(
        "_centres",
        lambda c: F.struct(F.abs(c["total"] - F.col("_total")).alias("diff"), c["cluster"].alias("cluster")),
    )
    return stations.select(
        "number", "name", F.array_min(distance)["cluster"].cast("string").alias("cluster")
    )


def with_cluster(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    """Panel with its station's cluster; the panel keeps its own name."""
    return panel.join(clusters.select("number", "cluster").distinct(), "number", "left")


def with_cluster_by_name(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    return panel.join(clusters.select("number", "name", "cluster"), ["number", "name"], "left")


def station_curves(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean free docks per station and slot, with the cluster."""
    joined = with_cluster_by_name(panel, clusters)
    return joined.groupBy("number", "name", "address", "slot", "cluster").agg(
        F.avg("available_stands").alias("av_stands")
    )


def cluster_curves(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    joined = with_cluster_by_name(panel, clusters)
    return joined.groupBy("slot", "cluster").agg(F.avg("available_stands").alias("av_stands"))


def cluster_map(clusters: DataFrame, stations: DataFrame) -> DataFrame:
    points = stations.select("number", "latitude", "longitude")
    return clusters.select("number", "name", "cluster").distinct().join(points, "number", "left")


def cluster_means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])


def with_cluster_slot_means(rows: DataFrame) -> DataFrame:
    """Each row with the mean in and out of its station, slot and cluster.

    A station's slot occurs once a day, so the window is bounded by its days.
    """
    group = W.partitionBy("number", "slot", "cluster")
    return rows.withColumns(
        {
            "cluster_mean_in": F.avg("check_in").over(group),
            "cluster_mean_out": F.avg("check_out").over(group),
        }
    )
