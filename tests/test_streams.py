import pytest

from hazegrid.streaming import readings as streams

SCHEMA = "station int, t timestamp, v double"


def land(spark, folder, rows):
    spark.createDataFrame(rows, "station int, t string, v double").selectExpr("station", "cast(t as timestamp) t", "v").coalesce(1).write.mode(
        "append").parquet(folder)


def source(spark, folder):
    return streams.read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def newest(frame):
    return {r["station"]: (str(r["t"]), r["v"]) for r in frame.collect()}


def test_latest_over_many_files_with_a_restart(spark, tmp_path):
    folder, root, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    land(spark, folder, [(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 05:00:00", 2.0), (2, "2024-01-01 05:00:00", 2.5)])
    land(spark, folder, [(1, "2024-03-01 00:00:00", 3.0), (1, "2024-02-01 00:00:00", 9.0)])
    first = newest(streams.upsert_latest(source(spark, folder), ["station"], "t", root, state))
    assert first == {1: ("2024-03-01 00:00:00", 3.0), 2: ("2024-01-01 05:00:00", 2.5)}
    # far behind everything seen so far: station 3 is new and stays, station 1 has a newer row
    land(spark, folder, [(3, "2023-01-01 00:00:00", 4.0), (1, "2023-01-01 00:00:00", 5.0), (None, "2024-01-01 00:00:00", 8.0)])
    land(spark, folder, [(2, "2024-04-01 00:00:00", 6.0)])
    again = newest(streams.upsert_latest(source(spark, folder), ["station"], "t", root, state))
    assert again == {1: ("2024-03-01 00:00:00", 3.0), 2: ("2024-04-01 00:00:00", 6.0), 3: ("2023-01-01 00:00:00", 4.0), None: ("2024-01-01 00:00:00", 8.0)}
    assert newest(streams.upsert_latest(source(spark, folder), ["station"], "t", root, state)) == again
    assert newest(streams.latest_rows(spark, root, spark.createDataFrame([], SCHEMA).schema)) == again


def test_only_touched_buckets_are_written_and_a_batch_can_run_again(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "table")
    land(spark, folder, [(k, "2024-01-01 00:00:00", float(k)) for k in range(200)])
    land(spark, folder, [(7, "2024-01-02 00:00:00", -1.0)])
    streams.upsert_latest(source(spark, folder), ["station"], "t", root, str(tmp_path / "state"))
    written = [sorted(p.name for p in (tmp_path / "table" / "rows" / f"batch={n}").glob("bucket=*")) for n in (0, 1)]
    assert len(written[0]) == streams.BUCKETS and len(written[1]) == 1
    # without its checkpoint the same stream starts again from its first batch, over the table as it is
    rows = newest(streams.upsert_latest(source(spark, folder), ["station"], "t", root, str(tmp_path / "other")))
    assert len(rows) == 200 and rows[7] == ("2024-01-02 00:00:00", -1.0)


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = streams.upsert_latest(source(spark, str(tmp_path / "in")), ["station"], "t", str(tmp_path / "table"), str(tmp_path / "state"))
    assert out.count() == 0 and out.columns == ["station", "t", "v"]


def test_windows_go_on_after_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "datetime timestamp, cell_lat int, cell_lon int, pm2_5 double"

    def add(*rows):
        spark.createDataFrame([(t, 1, 2, v) for t, v in rows], "datetime string, cell_lat int, cell_lon int, pm2_5 double").selectExpr(
            "cast(datetime as timestamp) datetime", "cell_lat", "cell_lon", "pm2_5").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        return [(str(r["window_start"]), r["mean_pm"], r["count"]) for r in streams.run_available(
            streams.windowed_aqi(stream), out=out, state=state).orderBy("window_start").collect()]

    add(("2024-01-01 01:00:00", 10.0), ("2024-01-01 08:00:00", 20.0))
    add(("2024-01-01 09:00:00", 40.0))
    assert run() == [("2024-01-01 00:00:00", 10.0, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == streams.ROCKSDB
    # the open window's state comes back from the checkpoint; the closed one takes no more rows
    add(("2024-01-01 02:00:00", 99.0), ("2024-01-01 10:00:00", 60.0))
    add(("2024-01-02 00:00:00", 5.0))
    assert run() == [("2024-01-01 00:00:00", 10.0, 1), ("2024-01-01 06:00:00", pytest.approx(40.0), 3)]


def test_mean_of_a_window_is_the_same_in_any_order(spark):
    values = [0.1] * 9 + [1e12, 0.1]
    for order in (values, values[::-1]):
        rows = [("2024-01-01 00:00:00", v) for v in order] + [("2024-01-02 00:00:00", 0.1)] * 10 + [("2024-01-03 00:00:00", None), ("2024-01-04 00:00:00", float("nan"))]
        frame = spark.createDataFrame(rows, "t string, pm2_5 double").coalesce(1).selectExpr(
            "cast(t as timestamp) datetime", "1 cell_lat", "1 cell_lon", "pm2_5")
        got = {str(r["window_start"])[8:10]: (r["mean_pm"], r["count"]) for r in streams.windowed_aqi(frame).collect()}
        assert got["01"] == ((10 ** 12 + 1) / 11, 11) and got["02"] == (0.1, 10) and got["03"] == (None, 0)
        assert got["04"][0] != got["04"][0]
