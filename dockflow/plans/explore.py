"""Exploration of the activity panel: coverage, rankings, roll-ups.

Every function is one aggregation with partial aggregation before the shuffle,
or a join of such results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions import calendar as cal
from dockflow.functions.flows import activity
from dockflow.functions.service import ACTIVE_TOTAL, activity_label
from dockflow.operators.ranking import exact_quantiles, top_n


def coverage(panel: DataFrame) -> DataFrame:
    """Panel rows per calendar day."""
    return panel.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).select(
        F.year("date").alias("y"), F.month("date").alias("m"), F.dayofmonth("date").alias("d"), "rows"
    )


def missing_days(panel: DataFrame) -> DataFrame:
    """Days between the first and last date without any row."""
    days = panel.select("date").distinct()
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi")).alias("date")
    )
    return calendar.join(days, "date", "left_anti")


def in_month(panel: DataFrame, month: int) -> DataFrame:
    return panel.where(F.month("date") == month)


def totals(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total check-in, check-out and activity per key."""
    return panel.groupBy(*by).agg(
        F.sum("check_in").alias("tot_check_in"),
        F.sum("check_out").alias("tot_check_out"),
        F.sum(activity()).alias("tot_act"),
    )


def top_by_check_in(panel: DataFrame, n: int = 10) -> DataFrame:
    per = panel.groupBy("name").agg(F.sum("check_in").alias("tot_check_in"))
    return top_n(per, n, "tot_check_in")


def top_by_check_out(panel: DataFrame, n: int = 10) -> DataFrame:
    per = panel.groupBy("name").agg(F.sum("check_out").alias("tot_check_out"))
    return top_n(per, n, "tot_check_out")


def top_by_activity(panel: DataFrame, n: int = 10, by: str = "address") -> DataFrame:
    """Most active (n > 0) or least active (n < 0) places, ties kept."""
    per = panel.groupBy(by).agg(F.sum(activity()).alias("tot_act"))
    return top_n(per, n, "tot_act")


def rows_of(panel: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """All panel rows of the selected keys."""
    return panel.join(selected.select(key), key, "left_semi")


def weekday_means(panel: DataFrame) -> DataFrame:
    return panel.groupBy("number", "name", "weekday").agg(
        F.avg("check_in").alias("avg_cin"), F.avg("check_out").alias("avg_cout")
    )


def weekday_activity(panel: DataFrame) -> DataFrame:
    return panel.groupBy("number", "name", "weekday").agg(F.sum(activity()).alias("tot_act"))


def box_statistics(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR) and number of points beyond them per group."""
    keys = list(by)
    quartiles = exact_quantiles(values, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        values.where(F.col(value).isNotNull())
        .join(quartiles, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value).cast("double"))).alias("low_whisker"),
            F.max(F.when(inside, F.col(value).cast("double"))).alias("high_whisker"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
    )


def weekday_boxes(panel: DataFrame) -> DataFrame:
    """Box statistics per weekday of the station means and station totals."""
    per = panel.groupBy("number", "name", "weekday").agg(
        F.avg("check_in").alias("avg_cin"),
        F.avg("check_out").alias("avg_cout"),
        F.sum(activity()).cast("double").alias("tot_act"),
    )
    long = per.unpivot(["weekday"], ["avg_cin", "avg_cout", "tot_act"], "measure", "value")
    return box_statistics(long, ["weekday", "measure"], "value")


def day_part_usage(panel: DataFrame) -> DataFrame:
    part = cal.day_part(cal.hour_of(F.col("slot")))
    return panel.groupBy("number", "name", part.alias("period"), "weekday").agg(
        F.sum("check_in").alias("tot_in"),
        F.sum("check_out").alias("tot_out"),
        F.avg("check_in").alias("avg_in"),
        F.avg("check_out").alias("avg_out"),
    )


def hourly_spread(panel: DataFrame, number: int) -> DataFrame:
    hour = cal.hour_of(F.col("slot")).alias("t_hour")
    return panel.where(F.col("number") == number).groupBy("number", hour).agg(
        F.avg("check_in").alias("mean_in"),
        F.stddev_samp("check_in").alias("sd_in"),
        F.avg("check_out").alias("mean_out"),
        F.stddev_samp("check_out").alias("sd_out"),
    )


def slot_variability(panel: DataFrame) -> DataFrame:
    def four(column: str, short: str) -> list:
        return [
            F.stddev_samp(column).alias(f"sd_{short}"),
            F.avg(column).alias(f"mean_{short}"),
            F.max(column).alias(f"max_{short}"),
            F.min(column).alias(f"min_{short}"),
        ]

    return panel.groupBy("number", "name", "time", "slot").agg(
        *four("check_in", "in"), *four("check_out", "out")
    )


def most_variable_slots(panel: DataFrame, n: int = 10, from_hour: int = 5) -> DataFrame:
    """Per station the slots with the largest check-in deviation."""
    late = slot_variability(panel).where(cal.hour_of(F.col("slot")) >= from_hour)
    return top_n(late, n, "sd_in", by=["number", "name"])


def weekday_profile(panel: DataFrame, weekday: str, grain: str) -> DataFrame:
    """Summed in, out and activity of one weekday by ``hour`` or ``slot``."""
    unit = cal.hour_of(F.col("slot")) if grain == "hour" else F.col("slot")
    return panel.where(F.col("weekday") == weekday).groupBy(unit.alias(grain)).agg(
        F.sum("check_in").alias("check_in"),
        F.sum("check_out").alias("check_out"),
        F.sum(activity()).alias("activity"),
    )


def compare_stations(panel: DataFrame, numbers: Sequence[int], by_weekday: bool) -> DataFrame:
    """Mean in and out per slot (and weekday) of a few stations."""
    keys = ["name", "slot"] + (["weekday"] if by_weekday else [])
    return panel.where(F.col("number").isin(*numbers)).groupBy(*keys).agg(
        F.avg("check_in").alias("mean_in"), F.avg("check_out").alias("mean_out")
    )


def weekend_early(panel: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Saturday and Sunday, hours 6 to 9, per slot."""
    hour = cal.hour_of(F.col("slot"))
    picked = panel.where(
        F.col("number").isin(*numbers) & cal.is_weekend(F.col("weekday")) & (hour > 5) & (hour < 10)
    )
    return picked.groupBy("name", "slot", "weekday").agg(
        F.max("check_in").alias("max_in"),
        F.max("check_out").alias("max_out"),
        F.avg("check_in").alias("mean_in"),
        F.avg("check_out").alias("mean_out"),
    )


def busiest_and_quietest(
    panel: DataFrame, stations: DataFrame, n: int = 10, threshold: int = ACTIVE_TOTAL
) -> DataFrame:
    """Top and bottom places with label and coordinates."""
    ranked = top_by_activity(panel, n).unionByName(top_by_activity(panel, -n))
    places = (
        panel.select("number", "address")
        .distinct()
        .join(ranked, "address")
        .select("number", "address", "tot_act")
        .distinct()
        .withColumn("rank", activity_label(F.col("tot_act"), threshold))
    )
    return places.join(stations.select("number", "address", "name", "latitude", "longitude"),
                       ["number", "address"], "left")


def melt(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Every other column as (variable, value) rows."""
    values = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), values, "variable", "value")


def season_activity(panel: DataFrame) -> DataFrame:
    wide = panel.select("weekday", cal.season(F.col("date")).alias("season"), activity().alias("activity"))
    return (
        melt(wide, ["weekday", "season"])
        .groupBy("weekday", "season")
        .agg(F.sum("value").alias("activity"))
    )


def distinct_stations(panel: DataFrame) -> DataFrame:
    return panel.select("number", "name").distinct()


def slot_dimension(panel: DataFrame) -> DataFrame:
    """The time-of-day texts present, with their order and full-hour label."""
    label = F.when(cal.minute_of(F.col("slot")) == 0, cal.hour_label(F.col("time")))
    return panel.select("time", "slot").distinct().withColumn("label", label)


def ordered_weekdays(panel: DataFrame) -> DataFrame:
    """Activity by weekday and season with their places in the ordered categories."""
    season = cal.season(F.col("date"))
    per = panel.groupBy("weekday", season.alias("season")).agg(F.sum(activity()).alias("tot_act"))
    return per.withColumns({"weekday_place": cal.weekday_ord(F.col("weekday")), "season_place": cal.season_ord(F.col("season"))})


def between_times(panel: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows whose time of day, read from its text, lies in [begin, end)."""
    at = cal.slot_of_text(F.col("time"))
    ends = [cal.slot_of_text(F.lit(t)) for t in (begin, end)]
    return panel.where((at >= ends[0]) & (at < ends[1]))
