import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockflow.plans import clusters, profiles
from dockflow.schemas import DAY_SLOTS

PANEL = ("number int, name string, address string, date date, slot int, weekday string, bike_stands int, "
         "check_in bigint, check_out bigint, available_stands int")


def cell(number, day, slot, free, name=None):
    date = dt.date(2017, 1, 1) + dt.timedelta(days=day)
    return (number, name or f"S{number}", f"a{number}", date, slot, date.strftime("%a"), 40, 0, 0, free)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for number, base in ((1, 2), (2, 3), (3, 20), (4, 22), (5, 35), (6, 36)):
        for day in range(7):
            rows += [cell(number, day, s, base + (s // 600)) for s in DAY_SLOTS if (s + number + day) % 70]
    return spark.createDataFrame(rows, PANEL)


def test_filled_profile_has_no_gap(panel):
    long = profiles.filled(panel)
    assert long.count() == 6 * 7 * 144
    assert long.where(F.col("available_stands").isNull()).count() == 0


def test_wide_and_back(spark):
    df = spark.createDataFrame([cell(1, 0, 0, 5), cell(1, 0, 620, 7), cell(2, 1, 620, 9)], PANEL)
    wide = profiles.wide(profiles.cells(df))
    assert wide.columns[:3] == ["number", "date", "0_00_00"] and len(wide.columns) == 146
    row = wide.where("number = 1").first()
    assert (row["0_00_00"], row["10_20_00"], row["23_50_00"]) == (5, 7, None)
    back = profiles.long_from_wide(wide).where("available_stands is not null")
    assert sorted((r["number"], r["time"], r["available_stands"]) for r in back.collect()) == [
        (1, "0:00:00", 5), (1, "10:20:00", 7), (2, "10:20:00", 9)]


def test_repeated_cell_is_an_error(spark):
    df = spark.createDataFrame([cell(1, 0, 0, 5), cell(1, 0, 0, 6, name="OLD")], PANEL)
    with pytest.raises(Exception, match="two rows"):
        profiles.cells(df).collect()
    assert profiles.cells(profiles.without_names(df, ["OLD"])).count() == 1


def test_legacy_weekday_set_drops_thursday(panel):
    days = lambda s: sorted(r["weekday"] for r in profiles.on_weekdays(panel, s).select("weekday").distinct().collect())
    assert days(profiles.WEEKDAY_SET) == ["Mon", "Thu", "Tue", "Wed"]
    assert days(profiles.LEGACY_WEEKDAY_SET) == ["Mon", "Tue", "Wed"]


def test_kmeans_rows_sit_at_their_nearest_centre(spark, panel):
    points = clusters.profile_points(panel)
    model = clusters.fit_kmeans(points, k=3)
    centres = np.array(model.clusterCenters())
    for r in model.transform(points).collect():
        d = ((centres - r["features"].toArray()) ** 2).sum(axis=1)
        assert d[r["cluster"]] == pytest.approx(d.min())
    same = {r["number"]: r["cluster"] for r in model.transform(points).groupBy("number").agg(F.min("cluster").alias("cluster")).collect()}
    assert same[1] == same[2] and same[3] == same[4] and same[5] == same[6] and len(set(same.values())) == 3
    frame = clusters.centres_frame(spark, model)
    assert frame.count() == 3 * 144


def test_elbow_falls_and_starts_at_the_total(panel):
    points = clusters.profile_points(panel)
    k1 = clusters.total_spread_long(profiles.filled(panel)).first()["wss"]
    costs = dict(clusters.elbow(points, [2, 3]))
    matrix = np.array([r["features"].toArray() for r in points.collect()])
    assert k1 == pytest.approx(((matrix - matrix.mean(axis=0)) ** 2).sum())
    assert k1 > costs[2] > costs[3]


@pytest.mark.parametrize("rounds", [200, 3])  # enough, and too few to settle
def test_elbow_cost_is_that_of_the_fitted_centres(spark, monkeypatch, rounds):
    monkeypatch.setattr(clusters, "ROUNDS", rounds)
    rows = [(float(x), 0.0) for x in range(600)]
    points = clusters.flow_points(spark.createDataFrame(rows, "check_in double, check_out double")).coalesce(1)
    centres = np.array(clusters.fit_kmeans(points, 9).clusterCenters())
    within = ((np.array(rows)[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert dict(clusters.elbow(points, [9]))[9] == pytest.approx(within, rel=1e-9)


def test_days_hold_an_array_over_all_slots(spark, panel):
    df = spark.createDataFrame([cell(1, 0, 0, 5), cell(1, 0, 620, 7), cell(2, 1, 620, None)], PANEL)
    rows = {r["number"]: r["stands"] for r in profiles.days(df).collect()}
    assert len(rows[1]) == len(rows[2]) == 144 and rows[1][0] == 5 and rows[1][62] == 7 and rows[2] == [None] * 144
    assert profiles.wide_of(profiles.days(df)).columns == profiles.wide(profiles.cells(df)).columns
    with pytest.raises(Exception, match="two rows"):
        profiles.days(spark.createDataFrame([cell(1, 0, 0, 5), cell(1, 0, 0, 6, name="OLD")], PANEL)).collect()


def test_a_slot_without_any_value_is_left_out(spark):
    df = spark.createDataFrame([cell(n, d, s, n + s // 10) for n in (1, 2) for d in (0, 1) for s in (0, 10, 700)], PANEL)
    points = clusters.profile_points(df).collect()
    assert {tuple(r["features"]) for r in points} == {(n, n + 1.0, n + 70.0) for n in (1, 2)}
    model = clusters.fit_kmeans(clusters.profile_points(df), k=2)
    with pytest.raises(ValueError):
        clusters.centres_frame(spark, model)
    assert clusters.centres_frame(spark, model, [0, 10, 700]).count() == 6


def test_facts_tell_a_right_fit_from_a_wrong_one(spark, panel):
    points = clusters.profile_points(panel)
    model = clusters.fit_kmeans(points, k=3)
    rows, centres = model.transform(points), [c.tolist() for c in model.clusterCenters()]
    total = clusters.total_spread_long(profiles.filled(panel)).first()["wss"]
    right = clusters.fit_facts(rows, centres).first()
    assert (right["rows"], right["groups"], right["misplaced"], right["shifted"]) == (42, 3, 0, 0)
    assert right["within"] + right["between"] == pytest.approx(total)
    assert right["within"] == pytest.approx(model.summary.trainingCost)
    # one group for all, groups dealt at random, and centres that are off
    assert clusters.fit_facts(rows.withColumn("cluster", F.lit(1)), centres).first()["groups"] == 1
    dealt = clusters.fit_facts(rows.withColumn("cluster", F.pmod(F.hash("number", "date"), F.lit(3))), centres).first()
    assert dealt["misplaced"] > 0 and dealt["shifted"] > 0
    moved = clusters.fit_facts(rows, [[x + 0.3 for x in centres[0]], *centres[1:]]).first()
    assert moved["shifted"] == 1 and moved["within"] + moved["between"] != pytest.approx(total)


def test_subsets(panel):
    busy = panel.withColumn("check_in", F.col("number").cast("bigint"))
    top = clusters.profile_points(busy, top=2).select("number").distinct().collect()
    bottom = clusters.profile_points(busy, top=-2).select("number").distinct().collect()
    assert sorted(r[0] for r in top) == [5, 6] and sorted(r[0] for r in bottom) == [1, 2]
    assert clusters.profile_points(panel, weekdays=["Mon"]).count() == 6


def test_nearest_centre_tie_goes_to_lowest_id(spark):
    df = spark.createDataFrame([cell(1, 0, 0, 10), cell(2, 0, 0, 1)], PANEL)
    centres = spark.createDataFrame([(2, 0, 8.0), (1, 0, 12.0), (3, 0, 12.0)], "cluster int, slot int, available_stands double")
    got = {r["number"]: r["cluster"] for r in clusters.nearest_centre(df, centres).collect()}
    assert got == {1: "1", 2: "2"}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, b double")
    r = clusters.range_scaled(df, ["a", "b"]).orderBy("a").collect()
    assert [x["a"] for x in r] == [0.25, 0.75, 1.25] and r[0]["b"] is None
    z = clusters.zscored(df, ["a"]).orderBy("a").collect()
    assert [x["a"] for x in z] == [-1.0, 0.0, 1.0]
    assert clusters.total_spread(df, ["a", "b"]).first()["wss"] == 8.0
