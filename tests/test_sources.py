import json
import math

import pytest
from pyspark.sql import SparkSession

from hazegrid import session
from hazegrid.functions import fixed
from hazegrid.operators import stats
from hazegrid.sources import readers, schemas, writers
from hazegrid.streaming import readings as streams


def test_first_available(spark, tmp_path):
    good = str(tmp_path / "good.csv")
    spark.range(3).selectExpr("id AS pm", "'x' AS s").coalesce(1).write.option("header", True).csv(good)
    _, frame = readers.first_available(spark, [str(tmp_path / "none"), good], ["pm"], "csv", "pm double, s string")
    assert dict(frame.dtypes) == {"pm": "double", "s": "string"} and frame.count() == 3
    with pytest.raises(LookupError):
        readers.first_available(spark, [good], ["other"], "csv")
    bad = tmp_path / "bad.parquet"
    bad.write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        readers.first_available(spark, [str(bad), good], ["pm"])


def test_partitions_can_be_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "v int, day string")
    writers.write_table(frame, path, partition_by=["day"])
    writers.write_table(frame.where("day = 'a'").selectExpr("v + 10 AS v", "day"), path, partition_by=["day"], mode="overwrite_partitions")
    assert sorted(tuple(r) for r in spark.read.schema("v int, day string").parquet(path).collect()) == [(2, "b"), (11, "a")]
    with pytest.raises(ValueError):
        writers.write_table(frame, path, mode="overwrite_partitions")


def test_local_session_without_a_checkpoint_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    monkeypatch.setattr(session, "_LOCAL_ROOTS", {})
    first = session.shared_root(Session())
    assert first == session.shared_root(Session()) and session.scratch_path(Session(), "x").startswith(first)
    assert isinstance(spark, SparkSession)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    schema = "datetime timestamp, cell_lat int, cell_lon int, pm2_5 double"
    folder = tmp_path / "in"
    parts = [
        [("2024-01-01 01:00:00", 10.0), ("2024-01-01 07:00:00", 20.0)],
        [("2024-01-01 14:00:00", 40.0)],
        [("2024-01-01 02:00:00", 99.0), ("2024-01-01 13:30:00", 60.0)],  # the first is too late
        [("2024-01-02 06:00:00", 5.0)],
    ]
    for k, rows in enumerate(parts):
        frame = spark.createDataFrame([(t, 1, 2, v) for t, v in rows], "datetime string, cell_lat int, cell_lon int, pm2_5 double")
        frame.selectExpr("cast(datetime as timestamp) datetime", "cell_lat", "cell_lon", "pm2_5").coalesce(1).write.parquet(str(folder / f"p{k}"))
    stream = streams.read_stream(spark, str(folder / "*"), spark.createDataFrame([], schema).schema)
    out = streams.run_available(streams.windowed_aqi(stream)).orderBy("window_start").collect()
    assert [(r["mean_pm"], r["count"]) for r in out] == [(10.0, 1), (20.0, 1), (50.0, 2)]


def test_latest_keeps_the_newest(spark):
    frame = spark.createDataFrame([(1, 5, 1.0), (1, 7, 2.0), (2, 1, 3.0), (1, 7, 1.5)], "s int, t int, v double")
    assert sorted(tuple(r) for r in streams.latest_per_location(frame, ["s"], "t").collect()) == [(1, 7, 2.0), (2, 1, 3.0)]


def test_declared_schema_and_clean_readings(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "datetime,station_name,state,city,station_latitude,station_longitude,pm2_5,pm10,no2,so2,has_ground_truth\n"
        "2025-07-18 17:44:02.242233,A,S,C,12.9,77.6,NaN,80.5,,-1.0,True\n2025-07-18 20:44:02,B,S,C,28.6,77.2,41.5,,2.0,3.0,0\n")
    raw = readers.read_table(spark, str(tmp_path / "s.csv"), schemas.STATIONS, "csv")
    rows = {r["station_name"]: r for r in readers.clean_readings(raw).collect()}
    assert rows["A"]["pm2_5"] is None and rows["A"]["has_ground_truth"] is True and rows["A"]["no2"] is None
    assert rows["B"]["has_ground_truth"] is False and rows["A"]["datetime"].microsecond == 242233


def test_latest_file_report_and_document(spark, tmp_path):
    frame = spark.createDataFrame([("g", "2024-01-01", 1.0, 2.0, None)], "grid_id string, datetime string, latitude double, longitude double, pm2_5 double")
    report = writers.write_report(stats.quality_report(frame), str(tmp_path / "report"))
    lines = [r[0] for r in spark.read.text(report).collect()]
    assert "size | records: 1.0" in lines and "missing | pm2_5: 1.0" in lines and not any("missing | grid_id" in x for x in lines)
    newest = readers.latest_file(spark, [str(tmp_path / "report"), str(tmp_path / "absent")], "part-*")
    assert "part-" in newest
    metrics = spark.createDataFrame([(1.0, 2.0, 0.5, 7)], "mae double, rmse double, r2 double, n long")
    document = json.loads(writers.as_json(writers.metrics_document(metrics, "m", ["a", "b"], {"p": 1.0})).first()[0])
    assert document["best_model"]["parameters"] == {"p": 1.0} and document["dataset_info"]["features_used"] == ["a", "b"]


def test_full_grids_have_their_size():
    assert math.prod(map(len, fixed.FOREST_GRID.values())) == 108 and math.prod(map(len, fixed.BOOSTED_GRID.values())) == 243
