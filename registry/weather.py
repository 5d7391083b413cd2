"""Weather derived from the events, one row per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.plans import weather as wx
from dockflow.session import shared_dir
from dockflow.sources import readers
from registry import fixture as fx
from registry.demand import FEATURES, features
from registry.fixture import plain, reals, select

CORRELATED = ["av_bikes", *wx.MEASURES]


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    per = (
        fx.table(spark, sf, "events")
        .groupBy(F.to_date(ts).alias("day"), F.hour(ts).alias("hour"))
        .agg(
            F.min("event_id").alias("first"),
            F.max("value").alias("hi"),
            F.min("value").alias("lo"),
            F.count(F.lit(1)).alias("n"),
            F.max("user_id").alias("user"),
        )
    )
    date = F.expr("make_timestamp_ntz(year(day), month(day), dayofmonth(day), hour, 0, 0)")
    return per.select(
        F.when(F.col("first") % 97 != 0, date).alias("date"),
        (F.col("first") % 3).cast("int").alias("ind"),
        F.when(F.col("first") % 7 != 0, F.col("hi") / 10).alias("rain"),
        F.lit(0).alias("ind_1"),
        (F.col("hi") % 25).alias("temp"),
        F.lit(0).alias("ind_2"),
        (F.col("hi") % 19).alias("wetb"),
        F.col("lo").alias("dewpt"),
        F.col("n").cast("double").alias("vappr"),
        (F.col("user") % 60 + 40).cast("double").alias("rhum"),
        (F.col("first") % 50 + 980).cast("double").alias("msl"),
    )


def _file(s, d):
    """Written as CSV and read back by position; the header line is not used.

    Spark refuses to write a repeated column name, so blanks tell them apart.
    """
    path = shared_dir(s)
    header = ["date", "ind", "rain", "ind ", "temp", "ind  ", "wetb", "dewpt", "vappr", "rhum", "msl"]
    hourly(s, d).toDF(*header).write.option("header", True).csv(path)
    return plain(readers.weather_hourly(s, path))


def every_element(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly rows with the other elements of the code book."""
    first, user = F.col("msl") - 980, F.col("rhum") - 40
    return hourly(spark, sf).select(
        "*",
        F.lit(0).alias("ind_3"),
        (user % 31).alias("wdsp"),
        F.lit(2).alias("ind_4"),
        (user % 36 * 10).alias("wddir"),
        (first % 40).cast("int").alias("ww"),
        (first % 20).cast("int").alias("w"),
        (user % 10 / 10).alias("sun"),
        (F.col("vappr") * 10).alias("vis"),
        F.when(first % 5 == 0, F.lit(float(wx.NO_CEILING))).otherwise(user * 4).alias("clht"),
        (first % 9).cast("int").alias("clamt"),
    )


def _every_file(s, d):
    path = shared_dir(s)
    every_element(s, d).write.option("header", True).csv(path)
    return plain(wx.without_ceiling_code(readers.weather_hourly(s, path, every_element=True)))


QUERIES = {
    "source_weather_roundtrip": _file,
    "source_weather_every": _every_file,
    "weather_flagged": lambda s, d: plain(wx.flagged(hourly(s, d))),
    "weather_month": lambda s, d: plain(wx.in_month(hourly(s, d), 1)),
    "weather_clean": lambda s, d: plain(wx.clean(hourly(s, d))),
    "weather_daily": lambda s, d: plain(wx.daily_rain(wx.clean(hourly(s, d)))),
    "weather_summary": lambda s, d: plain(wx.summary(hourly(s, d), wx.MEASURES)),
    "weather_join": lambda s, d: plain(
        wx.join_features(features(s, d), wx.clean(hourly(s, d))).select(
            "number", "name", "date", "time", "hour", "av_bikes", *wx.MEASURES
        )
    ),
    "weather_corr": lambda s, d: plain(
        wx.correlations(wx.join_features(features(s, d), wx.clean(hourly(s, d))), CORRELATED)
    ),
}

HOURLY = """
per AS (SELECT date_trunc('hour', ts) AS hr, min(event_id) AS first, max(value) AS hi, min(value) AS lo, count(*) AS n,
               max(user_id) AS usr FROM events GROUP BY 1),
hourly AS (
  SELECT CASE WHEN first % 97 <> 0 THEN CAST(hr AS TIMESTAMP) END AS date, first % 3 AS ind,
         CASE WHEN first % 7 <> 0 THEN hi / 10 END AS rain, 0 AS ind_1, hi % 25 AS temp, 0 AS ind_2, hi % 19 AS wetb,
         lo AS dewpt, CAST(n AS DOUBLE) AS vappr, CAST(usr % 60 + 40 AS DOUBLE) AS rhum, CAST(first % 50 + 980 AS DOUBLE) AS msl
  FROM per)"""
CLEAN = """
clean AS (
  SELECT date, coalesce(rain, 0) AS rain, temp, wetb, dewpt, vappr, rhum, msl, strftime(date, '%Y') AS year,
         month(date) AS month, strftime(date, '%d') AS day, strftime(date, '%H') AS hour, strftime(date, '%M') AS minute
  FROM hourly WHERE date IS NOT NULL)"""
JOINED = """
joined AS (
  SELECT f.number, f.name, f.date, f.time, f.av_bikes, c.hour, c.rain, c.temp, c.wetb, c.dewpt, c.vappr, c.rhum, c.msl
  FROM half f JOIN clean c ON CAST(c.date AS DATE) = f.date AND c.hour = substr(f.time, 1, 2))"""

MEASURES = reals(*wx.MEASURES)
HOURLY_OUT = (
    "SELECT epoch_us(date) AS date, CAST(ind AS BIGINT) AS ind, CAST(ind_1 AS BIGINT) AS ind_1, "
    f"CAST(ind_2 AS BIGINT) AS ind_2, {MEASURES} FROM hourly"
)
PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i:]]

EVERY = """
every_element AS (
  SELECT *, 0 AS ind_3, (rhum - 40) % 31 AS wdsp, 2 AS ind_4, (rhum - 40) % 36 * 10 AS wddir, (msl - 980) % 40 AS ww,
         (msl - 980) % 20 AS w, (rhum - 40) % 10 / 10 AS sun, vappr * 10 AS vis,
         CASE WHEN (msl - 980) % 5 <> 0 THEN (rhum - 40) * 4 END AS clht, (msl - 980) % 9 AS clamt FROM hourly)"""

SQL = {
    "source_weather_roundtrip": select([HOURLY], HOURLY_OUT),
    "source_weather_every": select(
        [HOURLY, EVERY],
        HOURLY_OUT.replace(" FROM hourly", ", ") + fx.ints("ind_3", "ind_4", "ww", "w", "clamt") + ", "
        + reals("wdsp", "wddir", "sun", "vis", "clht") + " FROM every_element",
    ),
    "weather_flagged": select([HOURLY], HOURLY_OUT + " WHERE ind <> 0"),
    "weather_month": select([HOURLY], HOURLY_OUT + " WHERE month(date) = 1"),
    "weather_clean": select(
        [HOURLY, CLEAN],
        f"SELECT epoch_us(date) AS date, {MEASURES}, year, CAST(month AS BIGINT) AS month, day, hour, minute FROM clean",
    ),
    "weather_daily": select(
        [HOURLY, CLEAN],
        "SELECT year, CAST(month AS BIGINT) AS month, day, round(avg(rain) + 1.3e-9, 6) + 0.0 AS rain FROM clean GROUP BY year, month, day",
    ),
    "weather_summary": select(
        [HOURLY],
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, round(min({c}) + 1.3e-9, 6) + 0.0 AS min, round(avg({c}) + 1.3e-9, 6) + 0.0 AS mean, round(max({c}) + 1.3e-9, 6) + 0.0 AS max, "
            f"count(*) - count({c}) AS nulls, round(quantile_cont({c}, 0.25) + 1.3e-9, 6) + 0.0 AS q1, round(quantile_cont({c}, 0.5) + 1.3e-9, 6) + 0.0 AS median, "
            f"round(quantile_cont({c}, 0.75) + 1.3e-9, 6) + 0.0 AS q3 FROM hourly"
            for c in wx.MEASURES
        ),
    ),
    "weather_join": select(
        [*FEATURES, HOURLY, CLEAN, JOINED],
        f"SELECT CAST(number AS BIGINT) AS number, name, CAST(date AS VARCHAR) AS date, time, hour, av_bikes, {MEASURES} FROM joined",
    ),
    "weather_corr": select(
        [*FEATURES, HOURLY, CLEAN, JOINED],
        " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}) + 1.3e-9, 6) + 0.0 AS r FROM joined" for a, b in PAIRS),
    ),
}
