import math

import pytest
from pyspark.sql import functions as F

from dockflow.functions import queueing as q
from dockflow.plans import queue
from helpers import brute_queue, frame, snap
from test_panel import random_rows


def steady(sig, c, r):
    return 1 / (c + 1) if r == 1 else (1 - r) / (1 - r ** (c + 1)) * r ** sig


def prob(c, s, sig, r, lam, mu, t):
    total = 0.0
    for m in range(1, c + 1):
        x = m * math.pi / (c + 1)
        k = lam + mu - 2 * math.sqrt(lam * mu) * math.cos(x)
        w = lambda lv: math.sin(x * lv) - math.sqrt(r) * math.sin(x * (lv + 1))
        total += mu / k * w(s) * w(sig) * math.exp(-k * t) / k
    return steady(sig, c, r) * t - 2 * r ** ((sig - s) / 2) / (c + 1) * total


def bounds(c, r, lam, mu, t, ti):
    g = lambda s, sig: (prob(c, s, sig, r, lam, mu, t) - prob(c, s, sig, r, lam, mu, ti)) / t
    low = [s for s in range(c + 1) if 1 - g(s, 0) >= 0.95]
    high = [s for s in range(c + 1) if 1 - g(s, c) >= 0.95]
    return (min(low) if low else None, max(high) if high else -1)


def test_known_values(spark):
    rows = [(40.0, 10.0, 0.0, 0.8, 8.0, 10.0, 1.0), (30.0, 3.0, 30.0, 1.0, 5.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "c double, s double, sig double, r double, lam double, mu double, t double")
    got = [r["p"] for r in df.select(q.transition(*[F.col(x) for x in ("c", "s", "sig", "r", "lam", "mu", "t")]).alias("p")).collect()]
    want = [prob(int(c), s, sig, r, lam, mu, t) for c, s, sig, r, lam, mu, t in rows]
    assert got == pytest.approx(want, rel=1e-12)


def test_survey_values(spark):
    df = spark.range(1).select(
        q.mode_sum(40, 10, 0.8, 0, 8, 10, 1).alias("a"), q.transition(40, 10, 0, 0.8, 8, 10, 1).alias("p"),
        q.transition(30, 3, 30, 1, 5, 5, 6).alias("r"), q.steady_state(3, 9, 1).alias("u"))
    row = df.first()
    values = [row["a"], row["p"], row["r"]]
    assert any(v == pytest.approx(0.6074318880, abs=1e-9) for v in values)
    assert any(v == pytest.approx(0.9937202406, abs=1e-9) for v in values)
    assert row["u"] == pytest.approx(0.1)


def test_bounds_match_the_search(spark):
    cases = [(c, lam / mu, float(lam), float(mu), t, ti) for c in (1, 7, 20) for lam, mu in ((3, 4), (5, 5), (90, 30), (0.4, 0.3))
             for t, ti in ((10.0, 6.0), (2.0, 0.5))]
    df = spark.createDataFrame(cases, "c int, r double, lam double, mu double, t double, ti double")
    cols = [F.col("c").cast("double"), F.col("r"), F.col("lam"), F.col("mu"), F.col("t"), F.col("ti")]
    got = df.select("*", q.lower_bound(*cols).alias("lo"), q.upper_bound(*cols).alias("hi")).collect()
    for r in got:
        assert (r["lo"], r["hi"]) == bounds(r["c"], r["r"], r["lam"], r["mu"], r["t"], r["ti"])
    assert {-1} < {r["hi"] for r in got} or {r["lo"] for r in got} != {0}


def test_degenerate_parameters(spark):
    df = spark.createDataFrame(
        [(10.0, None, 1.0, 0.0), (10.0, 1.0, None, 2.0), (0.0, 1.0, 2.0, 2.0), (None, 0.5, 1.0, 2.0)],
        "c double, r double, lam double, mu double")
    cols = [F.col(x) for x in ("c", "r", "lam", "mu")]
    rows = df.select(q.lower_bound(*cols, 10.0, 6.0).alias("lo"), q.upper_bound(*cols, 10.0, 6.0).alias("hi"),
                     q.mode_sum(cols[0], 1, cols[1], 1, cols[2], cols[3], 1).alias("k")).collect()
    assert [r["lo"] for r in rows] == [None] * 4
    assert [r["hi"] for r in rows] == [None, None, -1, None]
    assert rows[2]["k"] is None


def queue_dict(df):
    return {(r["number"], r["name"], r["address"], r["date"], r["slot"]): (r["check_in"], r["check_out"], r["cust_ia"], r["service_ia"])
            for r in df.collect()}


@pytest.mark.parametrize("seed", [11, 12])
def test_queue_panel_matches_the_joins(spark, seed):
    # minute-grain times: several rows of one station share a moment
    rows = random_rows(seed, n=300, days=1)
    got, want = queue_dict(queue.queue_panel(frame(spark, rows))), brute_queue(rows)
    assert got.keys() == want.keys()
    for key, value in want.items():
        for mine, theirs in zip(got[key], value):
            assert mine == (None if theirs is None else pytest.approx(theirs, rel=1e-9)), key


def test_zero_mean_service_gives_no_ratio(spark):
    rows = [snap(1, f, t) for f, t in ((5, "2017-01-02T08:00:00"), (8, "2017-01-02T08:05:00"))]
    params = queue.queue_parameters(queue.queue_panel(frame(spark, rows))).collect()
    assert [p["rho"] for p in params] == [None]
    assert [p["lam"] for p in params] == [5.0]
