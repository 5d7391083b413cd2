"""Occupancy heatmaps and the geographic tables.

The station table joins without a hint: Spark broadcasts it while its size is
under the broadcast threshold and shuffles (with skew splitting) beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dockflow.functions import calendar as cal
from dockflow.functions.flows import occupancy
from dockflow.operators.keys import null_safe_join


def heatmap(panel: DataFrame, by_station: bool = False) -> DataFrame:
    """Mean bikes in place and capacity per slot and weekday."""
    keys = (["number"] if by_station else []) + ["slot", "weekday"]
    return panel.groupBy(*keys).agg(
        F.avg(occupancy()).alias("avg_bikes"), F.max("bike_stands").alias("bike_stands")
    )


def with_station_slot_mean(panel: DataFrame) -> DataFrame:
    """Each row with its station's mean and capacity for the slot and weekday.

    One station, slot and weekday occurs once a week, so the window is bounded.
    """
    group = W.partitionBy("number", "slot", "weekday")
    return panel.withColumns(
        {
            "avg_bikes": F.avg(occupancy()).over(group),
            "stands": F.max("bike_stands").over(group),
        }
    )


def with_overall_slot_mean(panel: DataFrame) -> DataFrame:
    """Each row with the all-station mean of its slot and weekday.

    There are at most 1 008 groups but each holds rows of every station, so the
    means are aggregated and broadcast instead of windowed.  A null-safe
    match adds no filter to one side, which would keep exchanges from being reused.
    """
    means = panel.groupBy("slot", "weekday").agg(F.avg(occupancy()).alias("avg_bikes"))
    return null_safe_join(panel, F.broadcast(means), ["slot", "weekday"], "left")


def station_titles(panel: DataFrame, exclude_address: str) -> DataFrame:
    """Address and capacity per station id, leaving out an outdated address."""
    return (
        panel.where(F.col("address") != exclude_address)
        .select("number", "address", "bike_stands")
        .distinct()
    )


def coordinates(stations: DataFrame) -> DataFrame:
    return stations.select("number", "latitude", "longitude")


def with_coordinates(panel: DataFrame, stations: DataFrame) -> DataFrame:
    return panel.join(coordinates(stations), "number", "left")


def without_coordinates(panel: DataFrame, stations: DataFrame) -> DataFrame:
    """Row count of stations with no complete coordinates."""
    complete = coordinates(stations).where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    # counted first: the join then sees one row per station
    counts = panel.groupBy("number").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(complete, "number", "left_anti")


def stations_with_panel(panel: DataFrame, stations: DataFrame) -> DataFrame:
    """Right join: coordinates first, every panel row kept."""
    return coordinates(stations).join(panel, "number", "right")


def map_part_free_docks(panel: DataFrame, stations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean free docks per station, day type and part of day, with coordinates.

    One aggregation serves the six maps; coordinates join the few result rows.
    ``size`` is the point size of the maps.
    """
    part = cal.map_part(cal.hour_of(F.col("slot")))
    per = (
        panel.withColumn("part", part)
        .where(F.col("part").isNotNull())
        .groupBy("number", "name", cal.day_type(F.col("weekday")).alias("day_type"), "part")
        .agg(F.avg("available_stands").alias("stands"))
    )
    return with_coordinates(per, stations).withColumn("size", F.col("stands") * 0.4)


def station_totals(panel: DataFrame, stations: DataFrame) -> DataFrame:
    """Total check-in and check-out per station with coordinates."""
    per = panel.groupBy("number").agg(
        F.sum("check_in").alias("check_in"), F.sum("check_out").alias("check_out")
    )
    return with_coordinates(per, stations)
