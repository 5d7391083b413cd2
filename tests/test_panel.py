import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockflow.plans import duplicates, explore
from dockflow.plans import panel as panels
from helpers import at, brute_panel, changes, frame, snap


def as_dict(panel):
    return {
        (r["number"], r["name"], r["address"], r["date"], r["slot"]): (
            r["bike_stands"], r["prev_period_diff"], r["check_in"], r["check_out"], r["available_stands"])
        for r in panel.collect()
    }


def random_rows(seed, stations=3, n=400, days=3):
    rng, start, rows = random.Random(seed), datetime(2017, 3, 5), []
    for _ in range(n):
        number = 1 if rng.random() < 0.5 else rng.randrange(1, stations + 1)
        ts = start + timedelta(seconds=rng.randrange(days * 86_400) // 60 * 60)
        name = "OLD" if number == 1 and rng.random() < 0.3 else None
        rows.append(snap(number, rng.randrange(0, 12), ts.isoformat(), name))
    return rows + rows[:: 10]


@pytest.mark.parametrize("order", [panels.CHRONOLOGICAL, panels.TEXT_HOUR])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_panel_matches_brute_force(spark, seed, order):
    rows = random_rows(seed)
    got = as_dict(panels.activity_panel(frame(spark, rows), order=order))
    assert got == brute_panel(rows, order == panels.TEXT_HOUR)


@pytest.mark.parametrize("order", [panels.CHRONOLOGICAL, panels.TEXT_HOUR])
def test_row_level_changes_match_brute_force(spark, order):
    rows = random_rows(7)
    df = panels.snapshot_changes(frame(spark, rows), order=order)
    got = sorted((r["number"], r["name"], r["available_bike_stands"], r["last_update"], r["prev_period_diff"])
                 for r in df.collect())
    want = sorted((r[0], r[1], r[4], r[5], d) for r, d in changes(rows, order == panels.TEXT_HOUR))
    assert got == want


def test_text_hour_order_differs(spark):
    rows = [snap(1, free, f"2017-03-05T{h:02d}:01:00") for h, free in ((1, 5), (2, 9), (10, 4), (19, 7))]
    chrono = as_dict(panels.activity_panel(frame(spark, rows)))
    text = as_dict(panels.activity_panel(frame(spark, rows), order=panels.TEXT_HOUR))
    diffs = lambda d: [v[1] for _, v in sorted(d.items())]
    assert diffs(chrono) == [0, 4, -5, 3]
    assert diffs(text) == [0, 2, -1, 3]  # order 1, 10, 19, 2


def test_single_snapshot_has_no_change(spark):
    panel = panels.activity_panel(frame(spark, [snap(3, 9, "2017-03-05T04:05:06")]))
    row = panel.first()
    assert (row["prev_period_diff"], row["check_in"], row["check_out"]) == (0, 0, 0)
    assert (row["time"], row["weekday"], row["slot"]) == ("4:00:00", "Sun", 240)
    assert explore.hourly_spread(panel, 3).first()["sd_in"] is None


def test_missing_stock_is_quarantined(spark):
    rows = [snap(1, 5, "2017-03-05T04:00:00"), snap(1, None, "2017-03-05T04:12:00"), snap(1, 8, "2017-03-05T04:25:00")]
    df = frame(spark, rows)
    usable, rejected = panels.quarantine(df)
    assert (usable.count(), rejected.count()) == (2, 1)
    got = [r["prev_period_diff"] for r in panels.activity_panel(df).orderBy("slot").collect()]
    assert got == [0, 3]


def test_invariants(spark):
    rows = random_rows(5)
    panel = panels.activity_panel(frame(spark, rows))
    assert panel.where(F.col("check_in") - F.col("check_out") != F.col("prev_period_diff")).count() == 0
    total = {r["number"]: r["s"] for r in panel.groupBy("number").agg(F.sum("prev_period_diff").alias("s")).collect()}
    from helpers import ordered
    assert total == {n: seq[-1][4] - seq[0][4] for n, seq in ordered(rows).items()}


def test_unknown_order_is_rejected(spark):
    with pytest.raises(ValueError):
        panels.activity_panel(frame(spark, [snap(1, 1, "2017-01-01T00:00:00")]), order="nope")


def test_period_ends(spark):
    panel = spark.createDataFrame([(d,) for d in ("2017-01-01", "2017-01-02", "2017-01-03")], "d string")
    panel = panel.select(F.to_date("d").alias("date"))
    assert panels.study_period(panel, "2017-01-01", "2017-01-03").count() == 3
    assert panels.half_open_period(panel, "2017-01-01", "2017-01-03").count() == 2
    assert panels.from_date(panel, "2017-01-02").count() == 2


def test_duplicates_add_up(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "COPIES_PER_ROW", 3)
    rows = [snap(1, 5, "2017-03-05T04:00:00")] * 11 + [snap(2, 5, "2017-03-05T04:00:00")] * 2 + [
        snap(3, 5, "2017-03-05T04:00:00")]
    df = frame(spark, rows)
    copies = duplicates.duplicate_rows(df)
    assert copies.count() == 11 == df.count() - df.distinct().count()
    assert {r["number"]: r["count"] for r in duplicates.multiplicity(df).collect()} == {1: 10, 2: 1}
    assert [r["number"] for r in duplicates.repeated_more_than_once(df).collect()] == [1]
    bars = {(r["dimension"], r["value"]): r["groups"] for r in duplicates.bars(df).collect()}
    assert bars[("weekday", "Sun")] == 2 and bars[("number", "1")] == 1


def test_missing_days(spark):
    days = spark.createDataFrame([("2017-01-01",), ("2017-01-04",)], "d string").select(F.to_date("d").alias("date"))
    assert sorted(str(r["date"]) for r in explore.missing_days(days).collect()) == ["2017-01-02", "2017-01-03"]
    assert explore.missing_days(days.where("false")).count() == 0


def test_at_helper():
    assert at("2017-01-01T00:00:00").year == 2017
