import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dockflow.plans import forecast
from test_profiles_clusters import PANEL, cell

CLUSTERS = "number int, name string, cluster string"


def clusters_of(spark, numbers):
    return spark.createDataFrame([(n, f"S{n}", str(n % 4 + 1)) for n in numbers], CLUSTERS)


def places(spark, numbers):
    return spark.createDataFrame([(n, f"S{n}", f"a{n}", 53.0 + n / 100, -6.0) for n in numbers],
                                 "number int, name string, address string, latitude double, longitude double")


def test_half_hour_mean_rounds_half_to_even(spark):
    # bikes 2 and 3 -> 2, bikes 3 and 4 -> 4
    rows = [cell(1, 0, 480, 38), cell(1, 0, 490, 37), cell(1, 0, 510, 37), cell(1, 0, 520, 36)]
    got = forecast.half_hour_features(spark.createDataFrame(rows, PANEL), clusters_of(spark, [1])).orderBy("time").collect()
    assert [(r["time"], r["av_bikes"], r["prev_bike_num"]) for r in got] == [("08:00", 2.0, 2.0), ("08:30", 4.0, 2.0)]


def test_previous_value_stays_inside_the_day(spark):
    rows = [cell(1, 0, 1430, 30), cell(1, 1, 0, 10)]
    got = forecast.half_hour_features(spark.createDataFrame(rows, PANEL), clusters_of(spark, [1])).orderBy("date").collect()
    assert [r["prev_bike_num"] for r in got] == [10.0, 30.0]
    assert [r["season"] for r in got] == ["Winter", "Winter"]


def test_positional_split(spark):
    rows = [cell(n, 0, 30 * i, 5) for n, k in ((1, 8), (2, 8), (3, 7)) for i in range(k)]
    feats = forecast.half_hour_features(spark.createDataFrame(rows, PANEL), clusters_of(spark, [1, 2, 3]))
    got = {r["row_index"]: r["split"] for r in forecast.positional_split(feats).collect()}
    assert sorted(got) == list(range(1, 24))
    assert sorted(i for i, s in got.items() if s == "test") == list(range(15, 21))
    assert sum(s == "train" for s in got.values()) == 17


def test_errors_by_stage(spark):
    df = spark.createDataFrame([(-1.0, 3.4)], "av_bikes double, pred double")
    held = forecast.held_out_metrics(df).first()
    assert held["rmse_raw"] == pytest.approx(4.4) and held["rmse_rounded"] == pytest.approx(4.0)
    unseen = forecast.unseen_metrics(df).first()
    import math
    assert unseen["rmsle_rounded"] == pytest.approx(math.log1p(3) - math.log1p(1))


def test_verdict_covers_every_case(spark):
    rows = [(1, 10.0, 10.0), (30, 30.0, 10.0), (60, 1.0, 10.0), (90, 0.0, 2.0)]
    df = spark.createDataFrame([(n, a, p, "Mon", "08:00", 40) for n, a, p in rows],
                               "number int, av_bikes double, pred double, weekday string, time string, bike_stands int")
    got = {r["number"]: r for r in forecast.stock_verdicts(df).collect()}
    error = ((20.0 ** 2 + 9.0 ** 2 + 2.0 ** 2) / 4) ** 0.5
    assert [got[n]["acc_pred"] for n in (1, 30, 60, 90)] == ["Sufficient", "Oversupply", "Sufficient", "Sufficient"]
    assert got[90]["low_bound"] == 0.0 and got[1]["gap"] == 3.0
    assert got[30]["gap"] == pytest.approx(20.0 - error)
    assert [got[n]["st_range"] for n in (1, 30, 60, 90)] == ["1-25", "26-50", "51-75", "76-102"]
    label = forecast.error_labels(df).first()
    assert label["range_label"] == f"Error range: {round(2 * error)} bikes"
    whole = df.where("number = 1").withColumn("pred", F.lit(7.0))
    assert forecast.error_labels(whole).first()["label"] == "Error margin: 3"


def test_station_sample(spark):
    rows = [cell(n, 0, 0, 5)[:7] + (n, 0, 5) for n in range(1, 41)]
    panel = spark.createDataFrame(rows, PANEL)
    picks = forecast.station_sample(panel, clusters_of(spark, range(1, 41))).collect()
    assert sum(p["pick"] == "sample" for p in picks) == 12
    assert {p["number"] for p in picks if p["pick"] == "top"} == {37, 38, 39, 40}
    assert {p["number"] for p in picks if p["pick"] == "bottom"} == {1, 2, 3, 4}
    assert len({p["number"] for p in picks}) == 20
    again = forecast.station_sample(panel.repartition(7), clusters_of(spark, range(1, 41))).collect()
    assert sorted(map(tuple, picks)) == sorted(map(tuple, again))


@pytest.fixture(scope="module")
def features(spark):
    rng, rows = random.Random(1), []
    for n in range(1, 9):
        for day in range(10):
            rows += [cell(n, day, s, max(0, min(40, int(20 + 15 * ((s // 60) in range(8, 18)) - n + rng.random() * 3))))
                     for s in range(0, 1440, 30)]
    panel = spark.createDataFrame(rows, PANEL)
    return forecast.with_place(forecast.half_hour_features(panel, clusters_of(spark, range(1, 9))), places(spark, range(1, 9)))


def test_forest_beats_the_mean_and_survives_saving(spark, features, tmp_path):
    split = forecast.time_split(features, "2017-01-08")
    train, test = split.where("split = 'train'"), split.where("split = 'test'").cache()
    model = forecast.fit_forest(train, trees=10, depth=6)
    scored = model.transform(test)
    mean = train.agg(F.avg("av_bikes")).first()[0]
    rmse = forecast.held_out_metrics(scored).first()["rmse_raw"]
    assert rmse < 0.5 * forecast.held_out_metrics(test.withColumn("pred", F.lit(mean))).first()["rmse_raw"]
    forecast.save_model(model, str(tmp_path / "model"))
    again = forecast.load_model(str(tmp_path / "model")).transform(test)
    assert forecast.held_out_metrics(again).first()["rmse_raw"] == pytest.approx(rmse)
    assert sum(r["importance"] for r in forecast.impurity_importance(spark, model).collect()) == pytest.approx(1.0)
    rise = {r["feature"]: r["increase"] for r in forecast.permutation_importance(model, test).collect()}
    assert set(rise) == {*forecast.CATEGORIES, *forecast.NUMBERS}
    assert max(rise, key=rise.get) in ("prev_bike_num", "time") and rise["longitude"] == pytest.approx(0.0)


def test_rows_without_place_are_left_out(spark, features):
    bare = features.withColumn("latitude", F.when(F.col("number") > 2, F.col("latitude")))
    assert forecast.complete_rows(bare).select("number").distinct().count() == 6


def test_unknown_level_gets_its_own_bucket(spark, features):
    model = forecast.fit_forest(features, trees=2, depth=2)
    odd = features.limit(1).withColumn("cluster", F.lit("9"))
    assert model.transform(odd).count() == 1
    assert dt.date(2017, 1, 1).strftime("%a") == "Sun"
