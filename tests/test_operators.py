import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.operators import checks, filters, quantiles, ranking, stats
from hazegrid.operators.quantiles import exact_quantiles
from hazegrid.plans import forecast, fusion, models
from hazegrid.session import stored

NAN = float("nan")


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    data = [(rng.choice("xyz"), rng.choice([rng.gauss(0, 1e3), rng.uniform(-1e-9, 1e-9), 5.0, -5.0])) for _ in range(4000)]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    found = exact_quantiles(spark.createDataFrame(data, "g string, v double"), "v", probs, ["g"]).collect()
    for row in found:
        own = np.array([v for g, v in data if g == row["g"]])
        assert row["n"] == len(own)
        for name, p in probs.items():
            assert row[name] == pytest.approx(float(np.quantile(own, p)), rel=1e-12, abs=1e-18)


def test_quantiles_of_odd_inputs(spark):
    frame = spark.createDataFrame(
        [("a", 1.7e308), ("a", -1.7e308), ("a", math.inf), ("a", -math.inf), ("a", NAN), ("a", None), (None, 3.0)],
        "`odd name` string, v double")
    got = {r["odd name"]: r for r in exact_quantiles(frame, "v", {"low": 0.0, "p": 1 / 3, "high": 1.0}, ["odd name"]).collect()}
    assert got["a"]["n"] == 4 and got["a"]["low"] == -math.inf and got["a"]["p"] == -1.7e308 and got["a"]["high"] == math.inf
    assert got[None]["p"] == 3.0
    assert exact_quantiles(frame.limit(0), "v", {"p": 0.5}).count() == 0
    assert exact_quantiles(frame.limit(0), "v", {"p": 0.5}, ["odd name"]).count() == 0


@pytest.mark.parametrize("reach", [quantiles.REACH, 0.2, 0.0])
def test_quantiles_whatever_the_brackets_hold(spark, monkeypatch, reach):
    """Sketches that err, gaps with many rows, one frequent value, small groups beside large ones."""
    monkeypatch.setattr(quantiles, "REACH", reach)
    monkeypatch.setattr(quantiles, "LEAST_REACH", 2 if reach else 0)
    monkeypatch.setattr(quantiles, "SKETCH_K", 8 if reach == 0 else quantiles.SKETCH_K)
    rng = random.Random(4)
    data = [("large", rng.lognormvariate(3, 2)) for _ in range(20_000)] + [("large", 7.5)] * 3000
    data += [(f"s{n}", rng.uniform(-1, 1)) for n in range(1, 9) for _ in range(n)] + [("flat", 2.0)] * 500
    data += [("ends", math.inf)] * 400 + [("ends", -math.inf)] * 400 + [("ends", float(k)) for k in range(400)]
    probs = {f"q{k}": p for k, p in enumerate((0.0, 0.1, 0.105, 0.5, 0.75, 0.999, 1.0))}
    found = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(data, "g string, v double").repartition(5), "v", probs, ["g"]).collect()}
    assert set(found) == {g for g, _ in data}
    for g, row in found.items():
        own = np.array([v for h, v in data if h == g])
        assert row["n"] == len(own)
        for name, p in probs.items():
            with np.errstate(invalid="ignore"):
                low, high = (float(np.quantile(own, p, method=m)) for m in ("lower", "higher"))
            share = p * (len(own) - 1) % 1
            assert row[name] == (low if low == high else pytest.approx(low * (1 - share) + high * share, rel=1e-9))


def test_only_brackets_are_stored_in_full(spark, monkeypatch):
    kept = {}

    def spy(df, label):
        kept.setdefault(label, []).append(stored(df, label))
        return kept[label][-1]

    monkeypatch.setattr(quantiles, "stored", spy)
    rows = spark.range(200_000).select((F.xxhash64("id") / 1e9).alias("v"))
    exact_quantiles(rows, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).collect()
    assert kept["values"][0].count() < 0.06 * 200_000 and kept["values"][0].agg(F.sum("_w")).first()[0] == 200_000


def test_summary_of_nothing(spark):
    row = stats.summary_stats(spark.createDataFrame([], "v double"), "v").first()
    assert row["count"] == 0 and row["median"] is None


def test_filters(spark):
    frame = spark.createDataFrame([(1, 28.6, 77.2, 5.0), (2, 10.0, 69.0, None), (3, None, 77.0, NAN), (4, 36.0, 73.0, 9.0)],
                                  "id int, latitude double, longitude double, pm double")
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(filters.exclude_zones(frame)) == [1]
    assert ids(filters.within_bounds(frame)) == [1, 2, 4]
    assert ids(filters.require_target(frame, "pm")) == [1, 4]
    assert ids(filters.filter_range(frame, "pm", 5.0, 5.0)) == [1]
    assert ids(filters.filter_category(frame, "id")) == [1, 2, 3, 4]


def test_dominant_ties_and_worst_row(spark):
    frame = spark.createDataFrame([("s", "b", 1, 4.0), ("s", "a", 2, 9.0), ("s", "a", 3, 9.0), ("s", "b", 4, 1.0)],
                                  "s string, c string, t int, v double")
    assert stats.dominant(frame, "c", ["s"]).first()["c"] == "a"
    assert ranking.worst_row(frame, "v", "t", ["s"]).first()["t"] == 2
    assert ranking.sample_n(frame, 2, ["t"]).count() == 2
    again = ranking.sample_n(frame.repartition(3), 2, ["t"])
    assert {r["t"] for r in again.collect()} == {r["t"] for r in ranking.sample_n(frame, 2, ["t"]).collect()}


def test_box_join_takes_the_lowest_priority(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, None, 1.0), (1, 1.0, 1.0)],
                                   "id int, latitude double, longitude double")
    boxes = spark.createDataFrame([("big", 0.0, 2.0, 0.0, 2.0, 2), ("small", 1.0, 1.5, 1.0, 1.5, 1)],
                                  "name string, lat_min double, lat_max double, lon_min double, lon_max double, priority int")
    got = sorted((r["id"], r["box"]) for r in fusion.box_join(points, boxes, 0.5).collect())
    assert got == [(1, "small"), (1, "small"), (2, "big"), (3, None), (4, None)]


def test_fusion_keeps_left_rows(spark):
    weather = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "cell_lat int, cell_lon int, datetime int")
    aod = spark.createDataFrame([(1, 1, 0, 0.4)], "cell_lat int, cell_lon int, datetime int, aod_550 double")
    ground = spark.createDataFrame([(1, 2, 0, 80.0)], "cell_lat int, cell_lon int, datetime int, pm2_5 double")
    got = {r["cell_lon"]: r for r in fusion.fuse(weather, aod, ground).collect()}
    assert len(got) == 2 and got[2]["has_ground_truth"] and not got[1]["has_ground_truth"] and got[1]["aod_550"] == 0.4


def test_station_match_tolerance_and_ties(spark):
    stations = spark.createDataFrame([(1, 13.1, 77.5), (2, 12.9, 77.5), (3, 13.2, 77.5), (4, None, 77.5)],
                                     "station_id int, latitude double, longitude double")
    got = fusion.match_stations(stations, 0.5, 0.15).collect()
    assert [(r["cell_lat"], r["cell_lon"]) for r in got] == [(26, 155)] and got[0]["station_id"] in (1, 2)


def test_forecast_of_each_zone_and_season(spark):
    places = spark.createDataFrame([("d", 28.5, 77.0), ("m", 19.0, 73.0), ("b", 13.0, 77.5), ("k", 22.5, 88.3), ("o", 25.0, 80.0)],
                                   "place string, latitude double, longitude double")
    for month, temp in ((1, 15.0), (4, 25.0), (9, 30.0), (11, 20.0)):
        start = F.lit(f"2024-{month:02d}-10 12:00:00").cast("timestamp")
        rows = {(r["place"], r["day_number"]): r for r in forecast.forecast(places, start, 5).collect()}
        assert len(rows) == 25 and {r["t2m_celsius"] for r in rows.values()} == {temp}
        assert rows["d", 0]["aod_550"] == pytest.approx(0.8) and rows["d", 4]["aod_550"] == pytest.approx(1.1)
        assert rows["m", 0]["blh"] == 900.0 and rows["o", 0]["wind_speed_10m"] == 4.0


def test_metrics_and_split(spark):
    frame = spark.createDataFrame([(i, float(i), float(i) + (1 if i % 2 else -1)) for i in range(100)], "id int, y double, p double")
    row = stats.regression_metrics(frame, "y", "p").first()
    assert row["mae"] == 1.0 and row["rmse"] == 1.0 and row["r2"] == pytest.approx(1 - 100 / 83325)
    train, test = models.hash_split(frame, ["id"])
    again, _ = models.hash_split(frame.repartition(7), ["id"])
    assert train.count() + test.count() == 100 and {r[0] for r in train.collect()} == {r[0] for r in again.collect()}


def test_temporal_checks_cross_midnight(spark):
    frame = spark.createDataFrame([("s", "2024-01-01 23:00:00", 1.0), ("s", "2024-01-02 00:00:00", 500.0),
                                   ("s", "2024-01-02 00:00:00", 501.0), ("s", "2024-01-03 00:00:00", 2.0)],
                                  "s string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r["gap_hours"], r["duplicate"], r["gap"], r["spike"]) for r in
           checks.temporal_checks(frame, "s", "t", "v", 3.0, 100.0).orderBy("t", "v").collect()]
    assert got == [(None, False, False, False), (1.0, False, False, True), (0.0, True, False, False), (24.0, False, True, True)]
