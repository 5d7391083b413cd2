"""Sources, duplicates and the activity panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions import calendar as cal
from dockflow.plans import duplicates, explore
from dockflow.plans import panel as panels
from dockflow.session import shared_dir
from dockflow.sources import readers, tables
from registry import fixture as fx
from registry.fixture import plain, select


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots as the files hold them: epoch milliseconds."""
    micros = cal.to_epoch_micros(F.col("last_update"))
    return fx.snapshots(spark, sf).withColumn("last_update", F.floor(micros / 1000).cast("bigint"))


FILE_COLUMNS = ["number", "name", "address", "bike_stands", "available_bike_stands", "last_update"]


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    position = F.struct(
        (F.lit(53.3) + F.col("number") * 0.002).alias("lat"),
        (F.lit(-6.3) + F.col("number") * 0.003).alias("lng"),
    )
    raw_rows(spark, sf).select(*FILE_COLUMNS, position.alias("position")).write.json(path)
    # written one object per line: each line is a document of the folder
    back = readers.snapshots_json(spark, path, multi_line=False)
    return plain(back)


def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """One file per hour, each an array of station objects with a nested position."""
    path = shared_dir(spark)
    position = F.struct((F.lit(53.3) + F.col("number") * 0.002).alias("lat"), (F.lit(-6.3) + F.col("number") * 0.003).alias("lng"))
    poll = F.floor(F.col("last_update") / 3_600_000)
    stations = F.collect_list(F.struct(*FILE_COLUMNS, position.alias("position")))
    arrays = raw_rows(spark, sf).groupBy(poll).agg(F.to_json(stations).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return plain(readers.snapshots_json(spark, path))


FAULTY = 100  # events under this id make the dump that is left out


def csv_without_first(spark: SparkSession, sf: str) -> DataFrame:
    """Two dumps; the first by name is left out."""
    path = shared_dir(spark)
    rows = raw_rows(spark, sf)
    for name, part in (("dump0", rows.where(F.col("event_id") < FAULTY).coalesce(1)), ("dump1", rows.where(F.col("event_id") >= FAULTY))):
        part.select(*FILE_COLUMNS).write.option("header", True).csv(f"{path}/{name}")
    return plain(readers.snapshots_csv(spark, f"{path}/*", skip_first=True))


def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th line holds a word where a number belongs; such lines are told
    apart, the others read as they are."""
    path = shared_dir(spark)
    stock = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("none"), F.col("event_id").cast("string")))
    rows = raw_rows(spark, sf).withColumn("available_bike_stands", F.coalesce(stock, F.col("available_bike_stands").cast("string")))
    rows.select(*FILE_COLUMNS).write.option("header", True).csv(path)
    good, bad = readers.split_corrupt(readers.snapshots_csv(spark, path, keep_corrupt=True))
    word = F.regexp_extract("record", "none[0-9]+", 0).alias("word")
    counted = good.groupBy("number").agg(F.count(F.lit(1)).alias("rows"), F.sum("available_bike_stands").alias("stock"))
    listed = bad.groupBy(word).agg(F.count(F.lit(1)).alias("rows"))
    return plain(counted.select("number", F.lit("").alias("word"), "rows", "stock").unionByName(
        listed.select(F.lit(None).cast("int").alias("number"), "word", "rows", F.lit(None).cast("bigint").alias("stock"))))


def station_file(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    fx.stations(spark, sf).toDF("Number", "Name", "Address", "Latitude", "Longitude").write.option("header", True).csv(path)
    return plain(readers.stations(spark, path))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    raw_rows(spark, sf).select(*FILE_COLUMNS).write.option("header", True).csv(path)
    return plain(readers.snapshots_csv(spark, path))


def stage_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark)
    tables.write_stage(fx.panel(spark, sf), path, ["date"])
    back = panels.study_period(tables.read_stage(spark, path), *fx.PERIOD)
    return plain(back.groupBy("number").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("check_in").alias("check_in"),
        F.sum("available_stands").alias("available_stands"),
    ))


def queue_order_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = panels.snapshot_changes(fx.snapshots(spark, sf), tiebreak=fx.TIEBREAK)
    return plain(rows.select(
        "number", "name", "event_id", "last_update", "available_bike_stands",
        "prev_period_diff", "check_in", "check_out"))


QUERIES = {
    "source_json_roundtrip": json_roundtrip,
    "source_csv_roundtrip": csv_roundtrip,
    "source_json_arrays": json_arrays,
    "source_csv_without_first": csv_without_first,
    "source_csv_quarantine": csv_quarantine,
    "source_stations": station_file,
    "stage_table_roundtrip": stage_roundtrip,
    "dedupe_snapshots": lambda s, d: plain(panels.dedupe(fx.snapshots(s, d))),
    "duplicate_rows": lambda s, d: plain(
        duplicates.duplicate_rows(fx.snapshots(s, d)).withColumn("duplicate", F.col("duplicate").cast("string"))
    ),
    "duplicate_counts": lambda s, d: plain(duplicates.multiplicity(fx.snapshots(s, d))),
    "duplicate_repeated": lambda s, d: plain(
        duplicates.repeated_more_than_once(
            fx.snapshots(s, d).withColumn("last_update", F.to_date("last_update").cast("timestamp_ntz")).drop("event_id")
        )
    ),
    "duplicate_bars": lambda s, d: plain(duplicates.bars(fx.snapshots(s, d))),
    "snapshot_changes": queue_order_changes,
    "panel_10min": lambda s, d: plain(fx.panel(s, d)),
    "panel_10min_text_hour": lambda s, d: plain(fx.panel(s, d, panels.TEXT_HOUR)),
    "panel_study_period": lambda s, d: plain(panels.study_period(fx.panel(s, d), *fx.PERIOD)),
    "panel_from_date": lambda s, d: plain(panels.from_date(fx.panel(s, d), fx.PERIOD[1])),
    "coverage_by_day": lambda s, d: plain(explore.coverage(fx.panel(s, d))),
    "missing_days": lambda s, d: plain(
        explore.missing_days(fx.panel(s, d).where(~F.dayofmonth("date").isin(8, 9, 10, 11, 12)))
    ),
    "stray_month": lambda s, d: plain(explore.in_month(fx.order_panel(s, d), 7)),
}

FILE_MILLIS = """
files AS (SELECT number, name, address, bike_stands, available_bike_stands,
                 (epoch_us(last_update) // 1000) * 1000 AS last_update FROM snap)"""

FILE_OUT = fx.ints("number") + ", name, address, " + fx.ints(
    "bike_stands", "available_bike_stands", "last_update"
)

DUP_KEYS = "number, name, address, bike_stands, available_bike_stands, last_update, event_id"
DUP = f"""
dup AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {DUP_KEYS}) AS rn FROM snap) WHERE rn > 1),
grouped AS (
  SELECT number, name, last_update, count(*) AS count, year(last_update) AS year, month(last_update) AS month,
         day(last_update) AS day, strftime(last_update, '%a') AS weekday
  FROM dup GROUP BY ALL)"""
GROUPED_OUT = (
    "CAST(number AS BIGINT) AS number, name, epoch_us(last_update) AS last_update, "
    + fx.ints("count", "year", "month", "day") + ", weekday"
)
SNAP_OUT = (
    fx.ints("number") + ", name, address, " + fx.ints("bike_stands", "available_bike_stands")
    + ", epoch_us(last_update) AS last_update, event_id"
)

SQL = {
    "source_json_roundtrip": select(
        [fx.SNAP, FILE_MILLIS],
        f"SELECT {FILE_OUT}, round(CAST(53.3 AS DOUBLE) + number * CAST(0.002 AS DOUBLE) + 1.3e-9, 6) + 0.0 AS position_lat, "
        "round(CAST(-6.3 AS DOUBLE) + number * CAST(0.003 AS DOUBLE) + 1.3e-9, 6) + 0.0 AS position_lng FROM files",
    ),
    "source_csv_roundtrip": select([fx.SNAP, FILE_MILLIS], f"SELECT {FILE_OUT} FROM files"),
    "source_json_arrays": select(
        [fx.SNAP, FILE_MILLIS],
        f"SELECT {FILE_OUT}, round(CAST(53.3 AS DOUBLE) + number * CAST(0.002 AS DOUBLE) + 1.3e-9, 6) + 0.0 AS position_lat, "
        "round(CAST(-6.3 AS DOUBLE) + number * CAST(0.003 AS DOUBLE) + 1.3e-9, 6) + 0.0 AS position_lng FROM files",
    ),
    "source_csv_without_first": select(
        [fx.SNAP, f"late AS (SELECT * FROM snap WHERE event_id >= {FAULTY})", FILE_MILLIS.replace("FROM snap", "FROM late")],
        f"SELECT {FILE_OUT} FROM files",
    ),
    "source_csv_quarantine": select(
        [fx.SNAP],
        "SELECT CAST(number AS BIGINT) AS number, '' AS word, count(*) AS rows, CAST(sum(available_bike_stands) AS BIGINT) AS stock "
        "FROM snap WHERE event_id % 50 <> 0 GROUP BY number UNION ALL "
        "SELECT NULL, concat('none', CAST(event_id AS VARCHAR)), count(*), NULL FROM snap WHERE event_id % 50 = 0 GROUP BY event_id",
    ),
    "source_stations": select(
        [fx.GEO], "SELECT CAST(number AS BIGINT) AS number, name, address, " + fx.reals("latitude", "longitude") + " FROM geo"
    ),
    "stage_table_roundtrip": select(
        [fx.PANEL],
        "SELECT CAST(number AS BIGINT) AS number, count(*) AS rows, CAST(sum(check_in) AS BIGINT) AS check_in, "
        "CAST(sum(available_stands) AS BIGINT) AS available_stands FROM panel "
        "WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY number",
    ),
    "dedupe_snapshots": select([fx.DEDUP], f"SELECT {SNAP_OUT} FROM dedup"),
    "duplicate_rows": select([fx.SNAP, DUP], f"SELECT {SNAP_OUT}, 'true' AS duplicate FROM dup"),
    "duplicate_counts": select([fx.SNAP, DUP], f"SELECT {GROUPED_OUT} FROM grouped"),
    "duplicate_repeated": select(
        [fx.SNAP, """
by_day AS (SELECT number, name, address, bike_stands, available_bike_stands,
                  CAST(CAST(last_update AS DATE) AS TIMESTAMP) AS last_update FROM snap),
dup AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY number, name, address, bike_stands, available_bike_stands, last_update) AS rn
  FROM by_day) WHERE rn > 1),
grouped AS (
  SELECT number, name, last_update, count(*) AS count, year(last_update) AS year, month(last_update) AS month,
         day(last_update) AS day, strftime(last_update, '%a') AS weekday
  FROM dup GROUP BY ALL)"""],
        f"SELECT {GROUPED_OUT} FROM grouped WHERE count > 1",
    ),
    "duplicate_bars": select(
        [fx.SNAP, DUP],
        "SELECT 'number' AS dimension, CAST(number AS VARCHAR) AS value, count(*) AS groups FROM grouped GROUP BY ALL "
        "UNION ALL SELECT 'day', CAST(day AS VARCHAR), count(*) FROM grouped GROUP BY ALL "
        "UNION ALL SELECT 'month', CAST(month AS VARCHAR), count(*) FROM grouped GROUP BY ALL "
        "UNION ALL SELECT 'weekday', weekday, count(*) FROM grouped GROUP BY ALL",
    ),
    "snapshot_changes": select(
        [fx.CHANGES],
        "SELECT CAST(number AS BIGINT) AS number, name, event_id, epoch_us(last_update) AS last_update, "
        "CAST(available_bike_stands AS BIGINT) AS available_bike_stands, diff AS prev_period_diff, "
        "CAST(CASE WHEN diff > 0 THEN diff ELSE 0 END AS BIGINT) AS check_in, "
        "CAST(CASE WHEN diff < 0 THEN -diff ELSE 0 END AS BIGINT) AS check_out FROM changes",
    ),
    "panel_10min": select([fx.PANEL], f"SELECT {fx.PANEL_OUT} FROM panel"),
    "panel_10min_text_hour": select([fx.TEXT_PANEL], f"SELECT {fx.PANEL_OUT} FROM panel"),
    "panel_study_period": select(
        [fx.PANEL],
        f"SELECT {fx.PANEL_OUT} FROM panel WHERE date >= DATE '2024-01-03' AND date <= DATE '2024-01-28'",
    ),
    "panel_from_date": select([fx.PANEL], f"SELECT {fx.PANEL_OUT} FROM panel WHERE date >= DATE '2024-01-28'"),
    "coverage_by_day": select(
        [fx.PANEL],
        "SELECT year(date) AS y, month(date) AS m, day(date) AS d, count(*) AS rows FROM panel GROUP BY ALL",
    ),
    "missing_days": select(
        [fx.PANEL],
        "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date FROM (SELECT unnest(generate_series("
        "(SELECT min(date) FROM panel)::TIMESTAMP, (SELECT max(date) FROM panel)::TIMESTAMP, INTERVAL 1 DAY)) AS d) "
        "WHERE CAST(d AS DATE) NOT IN (SELECT date FROM panel WHERE day(date) NOT IN (8, 9, 10, 11, 12))",
    ),
    "stray_month": select(
        [fx.ORDER_PANEL],
        "SELECT CAST(number AS BIGINT) AS number, CAST(date AS VARCHAR) AS date, weekday, check_in, check_out "
        "FROM order_panel WHERE month(date) = 7",
    ),
}
