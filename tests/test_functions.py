import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hazegrid.functions import (
    advisory_level, at_noon, category_attributes, cell_index, clamp, cpcb_aqi, cpcb_category, epa_category, fixed,
    forecast_dates, grid_id, location_status, region_of, zone_baseline,
)

NAN = float("nan")


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("pm,aqi,category", [
    (0.0, 0, "Good"), (30.0, 50, "Good"), (31.0, 51.6666667, "Satisfactory"), (60.0, 100, "Satisfactory"),
    (75.0, 150, "Moderate"), (90.0, 200, "Moderate"), (105.0, 250, "Poor"), (120.0, 300, "Poor"),
    (185.0, 350, "Very Poor"), (250.0, 400, "Very Poor"), (263.0, 410, "Severe"), (380.0, 500, "Severe"), (9e9, 500, "Severe"),
])
def test_index_at_the_limits(spark, pm, aqi, category):
    [(a, c)] = values(spark, [(pm,)], "pm double", cpcb_aqi("pm"), cpcb_category("pm"))
    assert a == pytest.approx(aqi) and c == category


def test_index_is_monotone(spark):
    found = [r[0] for r in spark.range(0, 50_000).select(cpcb_aqi(F.col("id") / 100)).collect()]
    assert found == sorted(found)


def test_epa_limits(spark):
    rows = [(12.0,), (12.1,), (35.5,), (55.4,), (150.4,), (250.4,), (250.5,)]
    assert [r[0] for r in values(spark, rows, "pm double", epa_category("pm"))] == [
        "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]


def test_missing_numbers_have_no_rating(spark):
    for row in values(spark, [(None,), (NAN,)], "pm double", cpcb_aqi("pm"), cpcb_category("pm"), epa_category("pm"),
                      clamp("pm", 5.0, 500.0), advisory_level("pm")):
        assert row == (None,) * 5


def test_missing_positions(spark):
    rows = [(None, 77.0), (28.0, None), (NAN, 77.0), (28.0, NAN)]
    for row in values(spark, rows, "latitude double, longitude double", location_status(), region_of(), zone_baseline()):
        assert row == ("unknown", None, None)
    assert values(spark, [(NAN,), (None,)], "x double", cell_index("x", 0.5)) == [(None,), (None,)]


def test_every_city_box_and_part(spark):
    rows = [((b + c) / 2, (d + e) / 2, n) for n, b, c, d, e in fixed.REGION_BOXES]
    rows += [(32.0, 79.0, "Northern India"), (22.0, 70.0, "Western India"), (25.0, 92.0, "Eastern India"),
             (21.0, 80.0, "Central India"), (10.0, 78.0, "Southern India")]
    for found, wanted in values(spark, rows, "latitude double, longitude double, name string", region_of(), "name"):
        assert found == wanted


def test_grid_names_follow_the_resolution(spark):
    frame = spark.range(0, 200).select(grid_id(F.col("id").cast("int"), F.lit(7), 0.05).alias("g"))
    assert frame.distinct().count() == 200
    assert values(spark, [(26, 155)], "a int, b int", grid_id("a", "b", 0.5)) == [("13.0_77.5",)]


def test_forecast_dates_start_at_noon(spark):
    [(some, none)] = values(spark, [(dt.date(2024, 2, 28),)], "d date", forecast_dates(at_noon("d"), 3), forecast_dates(at_noon("d"), 0))
    assert some == [dt.datetime(2024, 2, 28, 12), dt.datetime(2024, 2, 29, 12), dt.datetime(2024, 3, 1, 12)] and none == []


def test_category_scales_differ(spark):
    rows = [(n,) for n in ("Good", "Moderate", "Hazardous", "Severe", "nothing", None)]
    cpcb = [r[0]["level"] for r in values(spark, rows, "c string", category_attributes("c", "cpcb"))]
    epa = [r[0]["level"] for r in values(spark, rows, "c string", category_attributes("c", "epa"))]
    assert cpcb == [1, 3, None, 6, None, None] and epa == [1, 2, 6, None, None, None]
    with pytest.raises(ValueError):
        category_attributes("c", "other")


def test_clamp(spark):
    assert values(spark, [(1.0,), (700.0,), (42.0,), (math.inf,)], "x double", clamp("x", 5.0, 500.0)) == [
        (5.0,), (500.0,), (42.0,), (500.0,)]
