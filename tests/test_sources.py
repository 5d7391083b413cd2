import json

import pytest
from pyspark.sql import functions as F

from dockflow.plans import weather
from dockflow.session import shared_dir
from dockflow.sources import readers, tables

HEADER = "number,name,address,bike_stands,available_bike_stands,last_update\n"


def test_json_arrays_with_nested_position(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"f{i}.json").write_text(json.dumps([
            {"number": n, "name": f"S{n}", "address": "x", "bike_stands": 40, "available_bike_stands": n + i,
             "last_update": 1476403200123 + i, "position": {"lat": 53.1, "lng": -6.2}, "status": "OPEN"} for n in (1, 2)]))
    df = readers.snapshots_json(spark, str(tmp_path))
    assert df.count() == 4
    row = df.orderBy("number", "last_update").first()
    assert str(row["last_update"]) == "2016-10-14 00:00:00.123000" and row["position_lat"] == 53.1


def test_csv_folder_without_the_first_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"export{i}.csv").write_text(HEADER + f"{i},S,a,40,{i},1476403200000\n")
    whole = readers.snapshots_csv(spark, str(tmp_path))
    assert sorted(r["number"] for r in whole.collect()) == [0, 1, 2]
    rest = readers.snapshots_csv(spark, str(tmp_path), skip_first=True)
    assert sorted(r["number"] for r in rest.collect()) == [1, 2]
    one = readers.snapshots_csv(spark, str(tmp_path / "export2.csv"))
    assert [r["number"] for r in one.collect()] == [2]


def test_lines_that_do_not_fit_are_told_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,S,a,40,3,1476403200000\n2,S,a,forty,3,1476403200000\n")
    (tmp_path / "b.csv").write_text(HEADER + "3,S,a,40,,1476403200000\n")
    good, bad = readers.split_corrupt(readers.snapshots_csv(spark, str(tmp_path), keep_corrupt=True))
    assert sorted((r["number"], r["available_bike_stands"]) for r in good.collect()) == [(1, 3), (3, None)]
    row = bad.collect()
    assert len(row) == 1 and row[0]["record"].startswith("2,S,a,forty") and row[0]["file"].endswith("a.csv")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([{"number": 1, "bike_stands": 4}]))
    (tmp_path / "j" / "b.json").write_text("no json at all")
    good, bad = readers.split_corrupt(readers.snapshots_json(spark, str(tmp_path / "j"), keep_corrupt=True))
    assert [(r["number"], r["bike_stands"]) for r in good.collect()] == [(1, 4)]
    assert [(r["file"][-6:], r["record"]) for r in bad.collect()] == [("b.json", "no json at all")]


def test_the_first_file_is_found_when_rows_are_read(spark, tmp_path):
    (tmp_path / "export1.csv").write_text(HEADER + "1,S,a,40,1,1476403200000\n")
    (tmp_path / "export2.csv").write_text(HEADER + "2,S,a,40,1,1476403200000\n")
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    before = len(jobs())
    rows = readers.snapshots_csv(spark, str(tmp_path), skip_first=True)
    assert len(jobs()) == before  # nothing has run yet
    assert [r["number"] for r in rows.collect()] == [2]


def test_weather_with_every_element(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "date,ind,rain,ind,temp,ind,wetb,dewpt,vappr,rhum,msl,ind,wdsp,ind,wddir,ww,w,sun,vis,clht,clamt\n"
        "2016-10-14 05:00:00,0,0.1,0,9.5,1,8,7,10,80,1012,2,11,2,240,25,82,0.4,30000,999,7\n")
    r = weather.without_ceiling_code(readers.weather_hourly(spark, str(tmp_path / "w.csv"), every_element=True)).first()
    assert (r["msl"], r["wdsp"], r["wddir"], r["ww"], r["w"], r["sun"], r["vis"], r["clht"], r["clamt"]) == (
        1012.0, 11.0, 240.0, 25, 82, 0.4, 30000.0, None, 7)


def test_stations(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("Number,Name,Address,Latitude,Longitude\n1,A ROW,A Row,53.34,-6.26\n")
    row = readers.stations(spark, str(path)).first()
    assert (row["number"], row["latitude"]) == (1, 53.34)


def test_weather_header_repeats_a_name(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("date,ind,rain,ind,temp,ind,wetb,dewpt,vappr,rhum,msl\n"
                    "2016-10-14 05:00:00,2,,0,9.5,1,8,7,10,80,1012\n,0,0.1,0,9,0,8,7,10,80,1012\n")
    df = readers.weather_hourly(spark, str(path))
    assert weather.flagged(df).count() == 1
    clean = weather.clean(df).collect()
    assert len(clean) == 1
    r = clean[0]
    assert (r["rain"], r["temp"], r["year"], r["month"], r["day"], r["hour"], r["minute"]) == (
        0.0, 9.5, "2016", 10, "14", "05", "00")
    assert not {"ind", "ind_1", "ind_2"} & set(weather.clean(df).columns)


def test_cluster_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "1"), (2, "B", "3"), (2, "B", "3")], "number int, name string, cluster string")
    tables.write_cluster_csv(df, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"cluster=1", "cluster=3"}
    back = tables.read_cluster_csv(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == [(1, "A", "1"), (2, "B", "3")]


def test_stage_is_pruned_by_date(spark, tmp_path):
    df = spark.createDataFrame([(1, "2017-01-01"), (2, "2017-01-02")], "n int, d string").select("n", F.to_date("d").alias("date"))
    tables.write_stage(df, str(tmp_path / "s"), ["date"])
    day = tables.read_stage(spark, str(tmp_path / "s")).where(F.col("date") == F.lit("2017-01-02").cast("date"))
    assert [r["n"] for r in day.collect()] == [2] and len(day.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


class _Stub:
    """Session stand-in: the real setting is fixed when a context starts."""

    def __init__(self, setting, master):
        self.conf, self.sparkContext = self, self
        self.setting, self.master = setting, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default


def test_shared_folder_comes_from_the_session():
    assert shared_dir(_Stub("/shared/cp/", "yarn")).startswith("/shared/cp/dockflow-")
    assert shared_dir(_Stub("/shared/cp", "local[2]")).startswith("/shared/cp/dockflow-")
    with pytest.raises(RuntimeError):
        shared_dir(_Stub(None, "yarn"))
    assert "run-" in shared_dir(_Stub(None, "local[2]"))


def test_summary_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 8.0)], "a double, b double")
    got = {r["variable"]: r for r in weather.summary(df, ["a", "b"]).collect()}
    assert (got["a"]["median"], got["a"]["nulls"], got["b"]["q1"]) == (2.0, 1, 3.5)
    r = {(x["x"], x["y"]): x["r"] for x in weather.correlations(df, ["a", "b"]).collect()}
    assert r[("a", "b")] == pytest.approx(1.0)
