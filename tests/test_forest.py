import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexerModel, VectorAssembler

from dockflow import session
from dockflow.operators import forest
from dockflow.plans import forecast
from registry import demand

ROWS = "weekday string, time string, cluster string, season string, prev_bike_num double, latitude double, longitude double, av_bikes double"


def made(many, seed=3):
    rng, out = random.Random(seed), []
    for _ in range(many):
        day, time, n = rng.choice(forecast.WEEKDAYS), rng.choice(forecast.HALF_HOURS), rng.randrange(12)
        before = float(rng.randrange(30))
        bikes = float(round(0.6 * before + 8 * (time > "12:00") + (day in ("Sat", "Sun")) * 3 + rng.random() * 4))
        out.append((day, time, str(n % 5), "Winter", before, 53.0 + n / 100, -6.0 - n % 3 / 100, bikes))
    return out + out[: many // 5]


def fitted(df, **settings):
    """The pipeline of the forecast with other settings of the forest."""
    pipeline = forecast.forest_pipeline()
    last = forest.ForestRegressor(label="av_bikes", prediction="pred", **settings)
    return Pipeline(stages=[*pipeline.getStages()[:-1], last]).fit(df)


def predictions(model, df):
    columns = [c for c in df.columns]
    return sorted(tuple(r) for r in model.transform(df).select(*columns, "pred").collect())


SETTINGS = {"trees": 4, "depth": 30, "bins": 256, "least": 5, "seed": 7}


def test_upper_nodes_give_the_same_forest(spark, tmp_path):
    """Nodes split by sums over all tasks, and nodes grown in one: one forest."""
    df = spark.createDataFrame(made(600), ROWS).cache()
    whole, parted = fitted(df, **SETTINGS), fitted(df, **SETTINGS, limit=60)
    assert all(len(t["feature"]) == 1 for t in whole.stages[-1].tops)
    assert all(len(t["feature"]) > 5 for t in parted.stages[-1].tops) and len(parted.stages[-1].bundles) > 12
    assert whole.stages[-1].totalNumNodes == parted.stages[-1].totalNumNodes > 300
    got, other = predictions(whole, df), predictions(parted, df)
    assert [r[:-1] for r in got] == [r[:-1] for r in other] and len(got) == 720
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in other], rel=1e-12)
    shares = parted.stages[-1].featureImportances.toArray()
    assert whole.stages[-1].featureImportances.toArray() == pytest.approx(shares) and shares.sum() == pytest.approx(1.0)
    forecast.save_model(parted, str(tmp_path / "model"))
    assert predictions(forecast.load_model(str(tmp_path / "model")), df) == other


def test_forest_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(made(300), ROWS)
    assert predictions(fitted(df.repartition(7), **SETTINGS), df) == predictions(fitted(df.coalesce(1), **SETTINGS), df)


def test_fit_takes_as_many_jobs_at_any_depth(spark):
    """A job for each group of nodes took most of the time of the forest in full."""
    df, jobs = spark.createDataFrame(made(600), ROWS).cache(), []
    for depth in (3, 30):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        model = forecast.fit_forest(df, trees=4, depth=depth)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}")))
        assert model.stages[-1].getNumTrees == 4
    assert jobs[1] <= jobs[0] + 2 <= 25


def brute(code, w, s, category, least):
    """The best gain of a node with one predictor, by every cut of the ordered bins."""
    order = sorted(range(len(code)), key=lambda i: s[i] / w[i] if category else code[i])
    best = 0.0
    for cut in range(1, len(order)):
        parts = [order[:cut], order[cut:]]
        sums = [(sum(w[i] for i in p), sum(s[i] for i in p)) for p in parts]
        if min(x for x, _ in sums) >= least:
            best = max(best, sum(y * y / x for x, y in sums) - sum(s) ** 2 / sum(w))
    return best


def test_best_split_of_every_slot():
    rng = random.Random(5)
    slots, category = [], []
    for _ in range(200):
        code = sorted(rng.sample(range(49), rng.randrange(1, 9)))
        w = [float(rng.randrange(1, 6)) for _ in code]
        slots.append((code, w, [x * rng.randrange(20) for x in w]))
        category.append(rng.random() < 0.5)
    flat = [np.array([x for part in slots for x in part[i]]) for i in range(3)]
    slot = np.repeat(np.arange(len(slots)), [len(code) for code, _, _ in slots])
    gain, rule = forest.best_splits(slot, flat[0], flat[1], flat[2], np.array(category), 5)
    for i, (code, w, s) in enumerate(slots):
        assert gain[i] == pytest.approx(brute(code, w, s, category[i], 5), abs=1e-9)
        if gain[i] > 0:
            left = forest.goes_left(np.array([category[i]] * len(code)), np.repeat(rule[i : i + 1], len(code)), np.array(code))
            w, s = np.array(w), np.array(s)
            assert s[left].sum() ** 2 / w[left].sum() + s[~left].sum() ** 2 / w[~left].sum() - s.sum() ** 2 / w.sum() == pytest.approx(gain[i])


def test_draws_are_poisson():
    key = np.arange(20_000)
    for n in (1, 3, 1500):
        w = forest.weights(key, np.zeros(len(key)), np.full(len(key), n), 1, 2)
        assert w.mean() == pytest.approx(n, rel=0.03) and w.var() == pytest.approx(n, rel=0.06)
    assert (forest.weights(key, key * 0.5, key % 3, 1, 2) == forest.weights(key[::-1], key[::-1] * 0.5, key[::-1] % 3, 1, 2)[::-1]).all()


def test_thresholds_lie_between_values():
    assert forest.thresholds([(3.0, 5), (1.0, 5), (2.0, 1)], 256) == [1.5, 2.5]
    assert forest.thresholds([(float(v), 10) for v in range(100)], 4) == [24.5, 49.5, 74.5]
    assert forest.thresholds([(1.0, 9)], 4) == []


def test_bins_of_numbers(spark):
    """A value on a threshold lies below it, as the split rule wants."""
    spec = {"arity": [0, 3], "cuts": [[1.5, 2.5], []]}
    df = spark.createDataFrame([([v, c],) for v, c in ((1.0, 0.0), (1.5, 1.0), (1.6, 2.0), (9.0, 2.0))], "x array<double>")
    assert [r[0] for r in df.select(forest.key_of(df["x"], spec)).collect()] == [0, 256, 513, 514]


def test_rows_without_a_split(spark):
    """Equal predictors make one leaf; no rows cannot be fitted."""
    df = spark.createDataFrame([("Mon", "08:00", "1", "Winter", 5.0, 53.0, -6.0, bikes) for bikes in [6.0, 8.0] * 20], ROWS)
    found = []
    for limit in (forest.LIMIT, 1):
        model = fitted(df, **SETTINGS, limit=limit)
        found.append({r["pred"] for r in model.transform(df).collect()})
        assert model.stages[-1].totalNumNodes == 4 and model.stages[-1].featureImportances.toArray().sum() == 0
    assert found[0] == found[1] and len(found[0]) == 1 and 6 < found[0].pop() < 8
    with pytest.raises(ValueError):
        fitted(df.limit(0), **SETTINGS)


def test_names_of_stages_stay(spark):
    stages = forecast.forest_pipeline().getStages()
    assert [type(s) for s in stages] == [StringIndexerModel] * 4 + [VectorAssembler, forest.ForestRegressor]
    spec = stages[-1].spec
    assert (spec["trees"], spec["depth"], spec["bins"], spec["least"], spec["tried"]) == (200, 30, 256, 5, 2)


def test_queries_read_the_split_rows_again(spark):
    """The features are not worked out again by each fit, score and fact."""
    split = demand._split_rows(spark, "/root/testdata/sf0.001")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "events" not in plan
    given = forecast.time_split(demand.features(spark, "/root/testdata/sf0.001"), "2024-01-15")
    assert split.dtypes == given.dtypes
    assert sorted(map(repr, split.collect())) == sorted(map(repr, given.collect()))


def test_a_saved_forest_needs_no_other_folder(spark, tmp_path):
    df = spark.createDataFrame(made(200), ROWS)
    model = fitted(df, **SETTINGS)
    got = predictions(model, df)
    forecast.save_model(model, str(tmp_path / "model"))
    session.remove_dir(spark, model.stages[-1].path)
    again = forecast.load_model(str(tmp_path / "model"))
    assert again.stages[-1].uid == model.stages[-1].uid and predictions(again, df) == got


def test_scores_are_the_same_to_the_last_digit(spark):
    """Parts of a prediction are added in one order, however the rows lie."""
    df = spark.createDataFrame(made(200), ROWS)
    model = fitted(df, **SETTINGS | {"trees": 40})
    assert len(model.stages[-1].bundles) > 3
    assert predictions(model, df.repartition(5)) == predictions(model, df.coalesce(1))


def test_every_row_is_scored_inside_the_range(spark):
    """Columns stay, equal predictors have equal predictions."""
    df = spark.createDataFrame(made(300), ROWS).cache()
    low, high = df.selectExpr("min(av_bikes)", "max(av_bikes)").first()
    scored = fitted(df, **SETTINGS).transform(df)
    assert scored.count() == df.count() and scored.where("pred is null").count() == 0
    assert scored.where(~scored["pred"].between(low, high)).count() == 0
    assert scored.columns[: len(df.columns)] == df.columns and scored.columns[-1] == "pred"
    assert scored.groupBy(*df.columns[:-1]).agg({"pred": "min"}).count() == df.select(*df.columns[:-1]).distinct().count()


def test_importance_is_the_share_of_the_gain(spark):
    """Of one predictor that tells all and others that are constant."""
    rows = [("Mon", "08:00", "1", "Winter", float(i % 20), 53.0, -6.0, float(i % 20 > 9)) for i in range(200)]
    shares = fitted(spark.createDataFrame(rows, ROWS), **SETTINGS | {"tried": 7}).stages[-1].featureImportances
    assert shares.toArray().tolist() == [0, 0, 0, 0, 1, 0, 0]


def test_a_saved_forest_keeps_its_importances(spark, tmp_path):
    model = fitted(spark.createDataFrame(made(200), ROWS), **SETTINGS)
    forecast.save_model(model, str(tmp_path / "model"))
    shares = forecast.impurity_importance(spark, forecast.load_model(str(tmp_path / "model")))
    assert shares.collect() == forecast.impurity_importance(spark, model).collect()
    assert shares.count() == 7 and sum(r["importance"] for r in shares.collect()) == pytest.approx(1.0)
