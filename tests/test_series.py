import datetime as dt
import random

import pytest

from dockflow.operators.series import fill_across, fill_arrays_across, fill_arrays_within, fill_within, with_reset_sum

GRID = "slot int, number int, date date, v int"


def day(i):
    return dt.date(2017, 1, 1) + dt.timedelta(days=i)


def brute_fill(rows, across):
    out = {}
    keys = {(r[0],) if across else (r[0], r[1]) for r in rows}
    for key in keys:
        seq = sorted(r for r in (x[:3] + (x[3] if x[3] is not None else -1,) for x in rows)
                     if (r[0],) == key or (r[0], r[1]) == key)
        known = [r[3] for r in seq if r[3] != -1]
        last = known[0] if known else None
        for r in seq:
            last = r[3] if r[3] != -1 else last
            out[r[:3]] = last
    return out


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_fill_runs_on_across_stations(spark, block):
    rng = random.Random(block)
    rows = [(s, n, day(d), rng.choice([None, None, rng.randrange(9)]))
            for s in (0, 10, 20) for n in (1, 2, 3, 7, 8, 9) for d in range(4)]
    rows += [(30, n, day(d), None) for n in (1, 2) for d in range(2)]  # an empty column
    df = spark.createDataFrame(rows, GRID)
    got = {(r["slot"], r["number"], r["date"]): r["v"]
           for r in fill_across(df, "v", "slot", "number", "date", block).collect()}
    assert got == brute_fill(rows, True)


def test_fill_within_stations(spark):
    rows = [(0, 1, day(0), None), (0, 1, day(1), 4), (0, 1, day(2), None), (0, 2, day(0), None), (0, 2, day(1), 7)]
    df = spark.createDataFrame(rows, GRID)
    got = {(r["slot"], r["number"], r["date"]): r["v"] for r in fill_within(df, "v", ["slot", "number"], "date").collect()}
    assert got == brute_fill(rows, False)


def test_running_sum_resets_at_zero(spark):
    values = [0, 3, 2, 0, 0, 5, 1]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, o int, v int")
    got = [r["s"] for r in with_reset_sum(df, "v", "s", ["k"], ["o"]).orderBy("o").collect()]
    assert got == [0, 3, 5, 0, 0, 5, 6]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_arrays_are_filled_as_columns_are(spark, block):
    r = random.Random(block)
    days = [(n, d, [r.choice([None, None, r.randrange(9)]) if i else None for i in range(6)]) for n in (1, 2, 3, 7, 9) for d in range(r.randint(1, 6))]
    r.shuffle(days)
    arrays = spark.createDataFrame(days, "number int, date int, v array<int>")
    long = spark.createDataFrame([(i, n, d, x) for n, d, v in days for i, x in enumerate(v)], "slot int, number int, date int, v int")
    want = {(x["number"], x["date"], x["slot"]): x["v"] for x in fill_across(long, "v", "slot", "number", "date", block).collect()}
    got = fill_arrays_across(arrays, "v", 6, "number", "date", block).collect()
    assert {(x["number"], x["date"], i): y for x in got for i, y in enumerate(x["v"])} == want
    want = {(x["number"], x["date"], x["slot"]): x["v"] for x in fill_within(long, "v", ["slot", "number"], "date").collect()}
    got = fill_arrays_within(arrays, "v", 6, "number", "date").collect()
    assert {(x["number"], x["date"], i): y for x in got for i, y in enumerate(x["v"])} == want
