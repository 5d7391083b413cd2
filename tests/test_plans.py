"""The physical plans keep the shapes the design relies on."""

import re

import pytest

import __spark_entry__ as entry_module
from dockflow.plans import panel as panels
from dockflow.plans import queue
from helpers import frame, snap

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["station_sample", "slot_variability_top_per_station"])
def test_group_limit_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SF))


def test_raw_rows_are_exchanged_once(spark):
    df = panels.activity_panel(frame(spark, [snap(1, 1, "2017-01-01T00:00:00")]))
    plan = plan_of(df)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # top down: rolled-up rows by station, raw rows by slot
    assert [len(e.split(",")) - 1 for e in exchanges] == [1, 3]
    # copies collapse before the exchange
    assert re.search(r"partial_collect_set", plan) and "SinglePartition" not in plan


@pytest.fixture
def plain_session(spark):
    """No broadcasts, and joins that want to be clustered by all their keys."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.requireAllClusterKeysForCoPartition": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df) -> str:
    """The plan as it ran; what is reused is printed once."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scans(plan: str) -> int:
    return len(re.findall(r"FileScan", plan))


QUEUE = ["queue_panel", "queue_mean_gaps", "queue_worst_gap", "queue_params", "interarrival", "interarrival_closed", "snapshot_changes"]


@pytest.mark.parametrize("name", QUEUE)
def test_queue_plans_scan_once_and_exchange_raw_rows_once(plain_session, name):
    plan = executed(QUERIES[name](plain_session, SF))
    assert scans(plan) == 1
    # the raw rows are those of the sets by station, date and slot; all else is rolled up
    assert len(re.findall(r"partial_collect_set", plan)) == 1
    if name.startswith("queue"):
        assert "Join" not in plan


def test_queue_panel_pairs_nothing(spark):
    plan = plan_of(queue.queue_panel(frame(spark, [snap(1, 1, "2017-01-01T00:00:00")])))
    # arrays are unfolded twice (a slot's rows, its open rows); no events are paired
    assert len(re.findall(r"Generate inline", plan)) == len(re.findall("Generate ", plan)) == 2


@pytest.mark.parametrize("name", ["profile_filled", "profile_filled_weekdays", "profile_wide", "elbow_k1_profiles"])
def test_gap_fill_scans_once_and_joins_no_grid(plain_session, name):
    plan = executed(QUERIES[name](plain_session, SF))
    assert scans(plan) == 1
    assert len(re.findall("explode", plan)) <= 1  # the planted copies of the given rows; no grid of slots
    assert plan.count("SortMergeJoin") <= 2  # the carried arrays, per station and per block


@pytest.mark.parametrize(("name", "most"), [("heatmap_rows_all", 1), ("heatmap_rows_station", 1), ("weather_corr", 3)])
def test_consumers_of_one_panel_share_its_scan(spark, name, most):
    plan = executed(QUERIES[name](spark, SF))
    # weather_corr reads the station table and the weather's own rows besides
    assert scans(plan) <= most and len(re.findall(r"partial_collect_set", plan)) == 1


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["weekday_activity"](spark, SF))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>", plan)
    plan = plan_of(QUERIES["stray_month"](spark, SF))
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan
