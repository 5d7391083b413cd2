"""Hourly weather: cleaning, daily means, summary, join and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators.ranking import exact_quantiles

MEASURES = ("rain", "temp", "wetb", "dewpt", "vappr", "rhum", "msl")
# of files with every element; 999 stands for no cloud ceiling
FURTHER = ("wdsp", "wddir", "ww", "w", "sun", "vis", "clht", "clamt")
NO_CEILING = 999
INDICATORS = ("ind", "ind_1", "ind_2", "ind_3", "ind_4")


def flagged(weather: DataFrame) -> DataFrame:
    """Readings whose rain indicator marks them as estimated or rejected."""
    return weather.where(F.col("ind") != 0)


def in_month(weather: DataFrame, month: int) -> DataFrame:
    return weather.where(F.month("date") == month)


def clean(weather: DataFrame) -> DataFrame:
    """Missing rain is none; date parts as columns; indicators dropped."""
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return (
        weather.where(F.col("date").isNotNull())
        .withColumns(
            {
                "rain": F.coalesce("rain", F.lit(0.0)),
                "year": F.year("date").cast("string"),
                "month": F.month("date"),
                "day": two(F.dayofmonth("date")),
                "hour": two(F.hour("date")),
                "minute": two(F.minute("date")),
            }
        )
        .drop(*INDICATORS)
    )


def without_ceiling_code(weather: DataFrame) -> DataFrame:
    """The code for no cloud ceiling is no height."""
    return weather.withColumn("clht", F.when(F.col("clht") != NO_CEILING, F.col("clht")))


def daily_rain(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("year", "month", "day").agg(F.avg("rain").alias("rain"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )
    plain = long.groupBy("variable").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"),
    )
    quartiles = exact_quantiles(long, ["variable"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(quartiles, "variable", "left")


def join_features(features: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Half-hour features with the weather of their date and hour."""
    hourly = cleaned.select(
        F.to_date("date").alias("date"), F.col("hour"), *[c for c in MEASURES if c in cleaned.columns]
    )
    return features.withColumn("hour", F.substring("time", 1, 2)).join(hourly, ["date", "hour"])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = [f"struct('{a}' AS x, '{b}' AS y, corr(`{a}`, `{b}`) AS r)" for a, b in pairs]
    return df.selectExpr(f"array({', '.join(rows)}) AS pairs").selectExpr("inline(pairs)")
