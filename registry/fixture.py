"""The given tables as station data, in Spark and as SQL text.

``events`` plays the snapshots: 25 stations, 5 % planted exact copies, one
station with two names.  ``nation`` plays the station table (one row missing),
``orders`` a multi-year activity table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions import calendar as cal
from dockflow.plans import panel as panels

OLD_NAME = "STATION 0 OLD"
TIEBREAK = ("event_id",)
PERIOD = ("2024-01-03", "2024-01-28")
WEEK = ("2024-01-15", "2024-01-22")
PAIR = (5, 8)
STATION = 5

# Given centres, four curves over the 144 slots: base and amplitude.
CENTRE_SHAPES = [(1, 5.0, 2.0), (2, 9.0, 3.0), (3, 14.0, 1.0), (4, 20.0, 4.0)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    number = (F.col("user_id") % 25).cast("int")
    text = number.cast("string")
    snap = events.select(
        number.alias("number"),
        F.when(F.col("user_id") == 0, OLD_NAME)
        .otherwise(F.concat(F.lit("STATION "), text))
        .alias("name"),
        F.concat(F.lit("Station "), text).alias("address"),
        (40 + number % 3 * 5).cast("int").alias("bike_stands"),
        (F.floor("value") % 41).cast("int").alias("available_bike_stands"),
        F.col("ts").cast("timestamp_ntz").alias("last_update"),
        "event_id",
    )
    # one scan: every 20th event is written twice
    copies = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return snap.withColumn("_copy", F.explode(copies)).drop("_copy")


SNAP = """
snap0 AS (
  SELECT CAST(user_id % 25 AS INTEGER) AS number,
         CASE WHEN user_id = 0 THEN 'STATION 0 OLD'
              ELSE concat('STATION ', CAST(user_id % 25 AS VARCHAR)) END AS name,
         concat('Station ', CAST(user_id % 25 AS VARCHAR)) AS address,
         CAST(40 + (user_id % 25) % 3 * 5 AS INTEGER) AS bike_stands,
         CAST(CAST(floor(value) AS BIGINT) % 41 AS INTEGER) AS available_bike_stands,
         ts AS last_update, event_id
  FROM events),
snap AS (SELECT * FROM snap0 UNION ALL SELECT * FROM snap0 WHERE event_id % 20 = 0)"""

DEDUP = SNAP + """,
dedup AS (SELECT DISTINCT * FROM snap)"""


def _changes(name: str, hour: str) -> str:
    return f""",
{name} AS (
  SELECT *, CAST(last_update AS DATE) AS date,
         CAST(hour(last_update) * 60 + floor(minute(last_update) / 10) * 10 AS INTEGER) AS slot,
         CAST(coalesce(available_bike_stands - lag(available_bike_stands) OVER (
           PARTITION BY number ORDER BY CAST(last_update AS DATE), {hour},
             floor(minute(last_update) / 10), last_update, event_id), 0) AS BIGINT) AS diff
  FROM dedup)"""


def _panel(name: str, source: str) -> str:
    return f""",
{name} AS (
  SELECT number, name, address, date, slot,
         concat(CAST(slot // 60 AS VARCHAR), ':', lpad(CAST(slot % 60 AS VARCHAR), 2, '0'), ':00') AS time,
         strftime(date, '%a') AS weekday,
         min(bike_stands) AS bike_stands,
         CAST(sum(diff) AS BIGINT) AS prev_period_diff,
         CAST(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END) AS BIGINT) AS check_in,
         CAST(sum(CASE WHEN diff < 0 THEN -diff ELSE 0 END) AS BIGINT) AS check_out,
         arg_max(available_bike_stands, last_update) AS available_stands
  FROM {source} GROUP BY number, name, address, date, slot)"""


CHANGES = DEDUP + _changes("changes", "hour(last_update)")
PANEL = CHANGES + _panel("panel", "changes")
TEXT_PANEL = (
    DEDUP + _changes("changes", "CAST(hour(last_update) AS VARCHAR)") + _panel("panel", "changes")
)


def panel(spark: SparkSession, sf: str, order: str = panels.CHRONOLOGICAL) -> DataFrame:
    return panels.activity_panel(snapshots(spark, sf), order=order, tiebreak=TIEBREAK)


def stations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    text = key.cast("string")
    return table(spark, sf, "nation").where(key != 20).select(
        key.cast("int").alias("number"),
        F.concat(F.lit("STATION "), text).alias("name"),
        F.concat(F.lit("Station "), text).alias("address"),
        (F.lit(53.3) + F.lit(0.002) * key).alias("latitude"),
        (F.lit(-6.3) + F.lit(0.003) * key).alias("longitude"),
    )


GEO = """
geo AS (SELECT n_nationkey AS number, concat('STATION ', CAST(n_nationkey AS VARCHAR)) AS name,
               concat('Station ', CAST(n_nationkey AS VARCHAR)) AS address,
               CAST(53.3 AS DOUBLE) + CAST(0.002 AS DOUBLE) * n_nationkey AS latitude,
               CAST(-6.3 AS DOUBLE) + CAST(0.003 AS DOUBLE) * n_nationkey AS longitude
        FROM nation WHERE n_nationkey <> 20)"""


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-year activity rows from orders (the events cover one month)."""
    date = F.to_date("o_orderdate")
    price = F.floor("o_totalprice")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).cast("int").alias("number"),
        date.alias("date"),
        cal.weekday_name(date).alias("weekday"),
        (price % 7).cast("bigint").alias("check_in"),
        (price % 5).cast("bigint").alias("check_out"),
    )


ORDER_PANEL = """
order_panel AS (
  SELECT CAST(o_custkey % 25 AS INTEGER) AS number, CAST(o_orderdate AS DATE) AS date,
         strftime(o_orderdate, '%a') AS weekday,
         CAST(floor(o_totalprice) AS BIGINT) % 7 AS check_in,
         CAST(floor(o_totalprice) AS BIGINT) % 5 AS check_out
  FROM orders)"""


def centres(spark: SparkSession) -> DataFrame:
    """The four given centres: base + amplitude * (slot / 1430)."""
    rows = [F.struct(F.lit(c).alias("cluster"), F.lit(b).alias("base"), F.lit(a).alias("amp"))
            for c, b, a in CENTRE_SHAPES]
    slots = F.explode(F.sequence(F.lit(0), F.lit(1430), F.lit(10))).alias("slot")
    return (
        spark.range(1)
        .select(F.inline(F.array(*rows)))
        .select("*", slots)
        .select(
            "cluster",
            F.col("slot").cast("int").alias("slot"),
            (F.col("base") + F.col("amp") * (F.col("slot") / 1430.0)).alias("available_stands"),
        )
    )


CENTRES = """
shapes(cluster, base, amp) AS (VALUES {rows}),
centres AS (
  SELECT cluster, CAST(slot AS INTEGER) AS slot,
         CAST(base AS DOUBLE) + CAST(amp AS DOUBLE) * (slot / CAST(1430 AS DOUBLE)) AS available_stands
  FROM shapes, (SELECT unnest(range(0, 1440, 10)) AS slot))""".format(
    rows=", ".join(str(row) for row in CENTRE_SHAPES)
)

# Clusters by nearest centre total, outdated name left out.
CLUSTERS = """
profile AS (
  SELECT number, name, slot, avg(available_stands) AS stands
  FROM panel WHERE name <> 'STATION 0 OLD' GROUP BY number, name, slot),
station_sum AS (SELECT number, sum(stands) AS total FROM profile GROUP BY number),
centre_sum AS (SELECT cluster, sum(available_stands) AS total FROM centres GROUP BY cluster),
nearest AS (
  SELECT s.number, c.cluster, row_number() OVER (
           PARTITION BY s.number ORDER BY abs(c.total - s.total), c.cluster) AS rn
  FROM station_sum s CROSS JOIN centre_sum c),
clusters AS (
  SELECT DISTINCT p.number, p.name, CAST(n.cluster AS VARCHAR) AS cluster
  FROM profile p JOIN nearest n ON p.number = n.number AND n.rn = 1)"""

HALF_HOUR = """
half0 AS (
  SELECT number, name, address, bike_stands, date, weekday,
         concat(lpad(CAST(slot // 60 AS VARCHAR), 2, '0'), CASE WHEN slot % 60 < 30 THEN ':00' ELSE ':30' END) AS time,
         round_even(avg(bike_stands - available_stands), 0) AS av_bikes
  FROM panel GROUP BY ALL),
half AS (
  SELECT h.number, h.name, h.address, h.bike_stands, h.date, h.weekday, h.time, h.av_bikes,
         CASE WHEN month(h.date) IN (11, 12, 1) THEN 'Winter' WHEN month(h.date) IN (2, 3, 4) THEN 'Spring'
              WHEN month(h.date) IN (5, 6, 7) THEN 'Summer' ELSE 'Autumn' END AS season,
         coalesce(lag(h.av_bikes) OVER (
           PARTITION BY h.number, h.name, h.address, h.bike_stands, h.date ORDER BY h.time), h.av_bikes) AS prev_bike_num,
         c.cluster, g.latitude, g.longitude
  FROM half0 h LEFT JOIN (SELECT DISTINCT number, cluster FROM clusters) c ON h.number = c.number
  LEFT JOIN geo g ON h.number = g.number)"""


# Means often end exactly halfway between two sixth digits, where the engines
# round differently; this moves them off the middle.  The SQL adds the same.
NUDGE = 1.3e-9


def plain(df: DataFrame, digits: int = 6, nudge: float = NUDGE) -> DataFrame:
    """Comparable output: bigint, rounded double, string; dates as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(nudge), digits)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            c = cal.to_epoch_micros(c.cast("timestamp_ntz"))
        out.append(c.alias(field.name))
    return df.select(*out)


def select(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body


def ints(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def reals(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {n}" for n in names)


def days(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


PANEL_OUT = (
    "number::BIGINT AS number, name, address, CAST(date AS VARCHAR) AS date, slot::BIGINT AS slot, time, weekday, "
    "bike_stands::BIGINT AS bike_stands, prev_period_diff, check_in, check_out, "
    "available_stands::BIGINT AS available_stands"
)
