import random

import numpy as np
import pytest

from dockflow.operators.ranking import exact_quantiles, row_index, top_n


def numbers(spark, values, by=None):
    return spark.createDataFrame([(i, v, "g") for i, v in enumerate(values)], "id int, v double, g string")


def test_ties_are_kept_and_nulls_left_out(spark):
    df = numbers(spark, [9.0, 7.0, 7.0, 5.0, None, 1.0, 1.0])
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(top_n(df, 2, "v")) == [0, 1, 2]
    assert ids(top_n(df, -1, "v")) == [5, 6]
    assert ids(top_n(df, -3, "v")) == [3, 5, 6]
    assert ids(top_n(df, 50, "v")) == [0, 1, 2, 3, 5, 6]
    assert ids(top_n(df.where("false"), 2, "v")) == []


@pytest.mark.parametrize("n", [1, -1, 3, -2])
def test_per_group_matches_rank(spark, n):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(6)), rng.choice(["a", "a", "a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v double, g string")
    want = []
    for g in ("a", "b", None):
        vals = sorted((r[1] for r in rows if r[2] == g), reverse=n > 0)
        edge = vals[min(abs(n), len(vals)) - 1]
        want += [r[0] for r in rows if r[2] == g and (r[1] >= edge if n > 0 else r[1] <= edge)]
    assert sorted(r["id"] for r in top_n(df, n, "v", by=["g"]).collect()) == sorted(want)


@pytest.mark.parametrize("splits", [2, 7, 100])
def test_quantiles_are_exact(spark, splits):
    rng = random.Random(splits)
    rows = [("hot", float(rng.randrange(5))) for _ in range(500)]
    rows += [("wide", rng.random() ** 5 * 1e6) for _ in range(333)]
    rows += [("one", 4.5), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, splits).collect()}
    for g in ("hot", "wide", "one"):
        vals = [v for k, v in rows if k == g and v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vals, p), rel=1e-12)


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"] == 4.5


@pytest.mark.parametrize("block", [2, 4096])
def test_row_index_is_the_global_position(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 5, 9, 14]), i) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, o int").repartition(5)
    got = {(r["k"], r["o"]): r["row_index"] for r in row_index(df, "k", ["o"], block).collect()}
    assert got == {row: i + 1 for i, row in enumerate(sorted(rows))}
