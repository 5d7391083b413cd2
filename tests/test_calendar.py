from datetime import datetime

from pyspark.sql import functions as F

from dockflow.functions import calendar as cal
from dockflow.functions import flows
from dockflow.schemas import SEASONS, WEEKDAYS


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_season_of_every_month(spark):
    rows = [(datetime(2017, m, 3),) for m in range(1, 13)]
    got = values(spark, rows, "t timestamp_ntz", cal.season(F.to_date("t")))
    w, s, u, a = SEASONS
    assert got == [w, s, s, s, u, u, u, a, a, a, w, w]


def test_day_parts(spark):
    rows = [(h,) for h in (4, 5, 11, 12, 18, 19, 23)]
    assert values(spark, rows, "h int", cal.day_part(F.col("h"))) == [
        "Late night", "Morning", "Morning", "Afternoon", "Afternoon", "Night", "Night"]
    assert values(spark, rows, "h int", cal.map_part(F.col("h"))) == [
        None, "morning", "afternoon", "afternoon", "evening", "evening", None]


def test_time_texts(spark):
    rows = [(datetime(2017, 1, 2, 9, 59, 59),), (datetime(2017, 1, 2, 10, 20),)]
    slot = cal.slot_of(F.col("t"))
    assert values(spark, rows, "t timestamp_ntz", cal.time_text(slot)) == ["9:50:00", "10:20:00"]
    assert values(spark, rows, "t timestamp_ntz", cal.half_hour_text(slot)) == ["09:30", "10:00"]
    assert values(spark, rows, "t timestamp_ntz", cal.minute_of(slot)) == [50, 20]
    texts = [("9:50:00",), ("23:10",), ("x",), ("",), (None,)]
    assert values(spark, texts, "s string", cal.slot_of_text(F.col("s"))) == [590, 1390, None, None, None]


def test_weekdays_ignore_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        day = spark.createDataFrame([(1476403200123 + i * 86_400_000,) for i in range(7)], "ms long")
        got = day.select(cal.from_epoch_millis(F.col("ms")).alias("t")).select(
            cal.weekday_name(F.to_date("t")), F.hour("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[0] for r in got] == ["Fri", "Sat", "Sun", "Mon", "Tue", "Wed", "Thu"]
    assert {r[1] for r in got} == {0}


def test_ordered_categories(spark):
    rows = [(w,) for w in [*WEEKDAYS, "Thur", None]]
    assert values(spark, rows, "w string", cal.weekday_ord(F.col("w"))) == [0, 1, 2, 3, 4, 5, 6, None, None]
    assert values(spark, [("Autumn",)], "w string", cal.season_ord(F.col("w"))) == [3]


def test_flows_of_missing_change(spark):
    rows = [(3,), (-2,), (0,), (None,)]
    assert values(spark, rows, "d int", flows.check_in(F.col("d"))) == [3, 0, 0, 0]
    assert values(spark, rows, "d int", flows.check_out(F.col("d"))) == [0, 2, 0, 0]


def test_missing_values_stay_missing(spark):
    from dockflow.functions import service

    none = spark.createDataFrame([(None, 1.0, 2.0), (1.0, None, 2.0), (3.0, 1.0, None)], "a double, low double, high double")
    a, low, high = F.col("a"), F.col("low"), F.col("high")
    rows = none.select(service.verdict(a, low, high).alias("v")).select("v", service.gap_size(F.col("v"), F.lit(1.0), F.lit(0.0), F.lit(2.0)).alias("g"))
    assert [tuple(r) for r in rows.collect()] == [(None, None)] * 3
    missing = F.lit(None).cast("int")
    row = spark.range(1).select(service.station_range(missing), service.activity_label(missing), cal.day_part(missing)).first()
    assert tuple(row) == (None, None, None)
