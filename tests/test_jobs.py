import math
import random
from datetime import datetime, timedelta

from dockflow import jobs
from dockflow.sources.tables import read_cluster_csv, read_stage
from helpers import brute_panel, frame, snap
from test_forecast import places

PERIOD, WEEK = ("2017-01-02", "2017-01-11"), ("2017-01-09", "2017-01-16")


def network():
    """Nine stations, ten days, a snapshot about every 20 minutes."""
    rng, rows = random.Random(2), []
    for n in range(1, 10):
        for step in range(11 * 72):
            ts = datetime(2017, 1, 2) + timedelta(minutes=20 * step, seconds=rng.randrange(600))
            base = 5 + 10 * (n % 3) + 4 * math.sin(ts.hour / 24 * 2 * math.pi)
            rows.append(snap(n, int(base + rng.random() * 4), ts.isoformat()))
    return rows + rows[::40]


def test_jobs_run_end_to_end(spark, tmp_path):
    out, rows = str(tmp_path), network()
    jobs.ingest(spark, frame(spark, rows), out)
    panel = read_stage(spark, f"{out}/panel")
    assert panel.count() == len(brute_panel(rows))
    assert read_stage(spark, f"{out}/duplicates").count() == len(rows) - len(set(rows))
    assert read_stage(spark, f"{out}/queue").count() == panel.count()
    assert "date=2017-01-05" in {p.name for p in (tmp_path / "panel").iterdir()}

    jobs.group_stations(spark, out, PERIOD, k=3)
    groups = {r["number"]: r["cluster"] for r in read_stage(spark, f"{out}/clusters").collect()}
    assert len(groups) == 9 and len(set(groups.values())) == 3
    assert all(groups[a] == groups[b] for a in groups for b in groups if a % 3 == b % 3)
    assert read_cluster_csv(spark, f"{out}/cluster_csv").count() == 9

    jobs.forecast_week(spark, out, places(spark, range(1, 10)), PERIOD, WEEK, trees=5, depth=5)
    metrics = {(r["rows"], r["metric"]): r["value"] for r in read_stage(spark, f"{out}/metrics").collect()}
    assert set(metrics) == {("held_out", "rmsle_raw"), ("held_out", "rmse_raw"), ("held_out", "rmse_rounded"),
                            ("unseen", "rmse_raw"), ("unseen", "rmsle_rounded")}
    assert 0 < metrics[("unseen", "rmse_raw")] < 5
    verdicts = read_stage(spark, f"{out}/verdicts").collect()
    assert {r["number"] for r in verdicts} == set(range(1, 10))
    assert {r["acc_pred"] for r in verdicts} <= {"Sufficient", "Oversupply", "Insufficient"}
    sample = {r["number"] for r in read_stage(spark, f"{out}/sample").collect()}
    trained = {r["number"] for r in read_stage(spark, f"{out}/features").select("number").distinct().collect()}
    assert trained == sample
