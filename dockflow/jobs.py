"""The three end-to-end jobs, joined by stage tables under one folder.

Each job reads what an earlier one wrote, so the panel is computed once however
many analyses follow, and a lost executor repeats one stage, not the history.

    raw, duplicates, panel, queue     written by :func:`ingest`
    centres, clusters, cluster_csv    written by :func:`group_stations`
    model, metrics, verdicts          written by :func:`forecast_week`
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.plans import clusters, duplicates, forecast, profiles, queue
from dockflow.plans import panel as panels
from dockflow.schemas import STUDY_YEAR, UNSEEN_WEEK
from dockflow.sources.tables import read_stage, write_cluster_csv, write_stage


def ingest(
    spark: SparkSession,
    snapshots: DataFrame,
    out: str,
    order: str = panels.CHRONOLOGICAL,
    tiebreak: Sequence[str] = panels.TIEBREAK,
) -> None:
    """Snapshots to raw, duplicate, panel and queue tables."""
    write_stage(snapshots, f"{out}/raw")
    raw = read_stage(spark, f"{out}/raw")
    write_stage(duplicates.duplicate_rows(raw), f"{out}/duplicates")
    write_stage(panels.activity_panel(raw, order, tiebreak), f"{out}/panel", ["date"])
    write_stage(queue.queue_panel(raw, order, tiebreak), f"{out}/queue", ["date"])


def group_stations(
    spark: SparkSession,
    out: str,
    period: tuple[str, str] = STUDY_YEAR,
    outdated_names: Sequence[str] = (),
    k: int = clusters.K,
    seed: int = clusters.SEED,
) -> None:
    """Panel to k profile centres and the station-to-cluster table."""
    panel = panels.study_period(read_stage(spark, f"{out}/panel"), *period)
    panel = profiles.without_names(panel, outdated_names)
    model = clusters.fit_kmeans(clusters.profile_points(panel), k, seed)
    write_stage(clusters.centres_frame(spark, model, profiles.present_slots(panel)), f"{out}/centres")
    centres = read_stage(spark, f"{out}/centres")
    write_stage(clusters.nearest_centre(panel, centres), f"{out}/clusters")
    write_cluster_csv(read_stage(spark, f"{out}/clusters"), f"{out}/cluster_csv")


def forecast_week(
    spark: SparkSession,
    out: str,
    stations: DataFrame,
    period: tuple[str, str] = STUDY_YEAR,
    week: tuple[str, str] = UNSEEN_WEEK,
    trees: int = forecast.TREES,
    depth: int = forecast.DEPTH,
    seed: int = forecast.SEED,
) -> None:
    """Panel and clusters to a forest, its errors and the week's verdicts."""
    panel, groups = read_stage(spark, f"{out}/panel"), read_stage(spark, f"{out}/clusters")
    study = panels.study_period(panel, *period)
    write_stage(forecast.station_sample(study, groups, seed=seed), f"{out}/sample")
    chosen = read_stage(spark, f"{out}/sample").select("number").distinct()

    rows = forecast.half_hour_features(study.join(chosen, "number", "left_semi"), groups)
    split = forecast.positional_split(forecast.with_place(rows, stations))
    write_stage(split, f"{out}/features", ["split"])
    features = read_stage(spark, f"{out}/features")
    model = forecast.fit_forest(features.where(F.col("split") == "train"), trees, depth, seed)
    forecast.save_model(model, f"{out}/model")

    test = forecast.complete_rows(features.where(F.col("split") == "test"))
    unseen = forecast.with_place(
        forecast.half_hour_features(panels.half_open_period(panel, *week), groups), stations
    )
    write_stage(forecast.scored_rows(model, unseen), f"{out}/scored")
    scored = read_stage(spark, f"{out}/scored")
    metrics = forecast.as_rows(forecast.held_out_metrics(model.transform(test)), "held_out").unionByName(
        forecast.as_rows(forecast.unseen_metrics(scored), "unseen")
    )
    write_stage(metrics, f"{out}/metrics")
    write_stage(forecast.stock_verdicts(scored), f"{out}/verdicts")
