"""Forecasts for many locations: one lazy plan from locations to daily rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    advisory_level, clamp, cpcb_aqi, cpcb_category, encode_location, fallback_pm25, fixed, forecast_dates,
    formula_pm25, pollution_alert, season, zone_baseline,
)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Add absent scoring inputs and fill their gaps with the defaults."""
    return df.withColumns({
        name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(float(value)))
        if name in df.columns else F.lit(float(value))
        for name, value in fixed.FEATURE_DEFAULTS.items()})


def expand_days(locations: DataFrame, start: Column, days: int) -> DataFrame:
    """One row per location and day, without a join: ``day_number`` from 0 and ``datetime``."""
    return locations.select("*", F.posexplode(forecast_dates(start, days)).alias("day_number", "datetime"))


def place_features(df: DataFrame) -> DataFrame:
    """Climatological inputs that depend on the place alone."""
    return df.withColumns({**encode_location(), "_zone": zone_baseline()}).withColumns({
        "aod_550": clamp(F.col("_zone.aod_base"), *fixed.AOD_LIMITS),
        "wind_speed_10m": clamp(F.col("_zone.wind_base"), fixed.WIND_MIN),
        "blh": clamp(F.col("_zone.blh_base"), fixed.BLH_MIN),
        "zone": F.col("_zone.zone"),
    }).drop("_zone")


def time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Climatological inputs that depend on the time alone."""
    temp, humid = F, F
    for number, (t, rh) in enumerate(fixed.SEASON_BASE, start=1):
        temp, humid = temp.when(F.col("season") == number, t), humid.when(F.col("season") == number, rh)
    return df.withColumns({"hour": F.hour(ts), "month": F.month(ts)}).withColumn(
        "season", season("month", "monsoon")).withColumns({
            "t2m_celsius": temp, "r2m": clamp(humid, *fixed.HUMIDITY_LIMITS)})


def baseline_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Climatological inputs at a place and time; the spread around the base values enters with its mean, zero."""
    return time_features(place_features(df), ts)


def score(df: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """PM2.5, index and category of rows with the scoring inputs.

    ``predict`` adds a column ``prediction`` (a fitted pipeline's transform, say);
    by default the closed formula does.  Where it gives none, AOD stands in.
    """
    rows = predict(df) if predict else df.withColumn("prediction", formula_pm25("linear", limit=False))
    pm = clamp(fallback_pm25("prediction", "aod_550"), *fixed.PM_LIMITS)
    return rows.withColumn("pm2_5", pm).withColumns({
        "aqi": cpcb_aqi("pm2_5").cast("int"), "category": cpcb_category("pm2_5")})


def forecast(locations: DataFrame, start: Column, days: int,
             predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Daily forecast of every location; AOD rises day by day up to a limit."""
    # what depends on the place is worked out once per location, before the days
    rows = time_features(expand_days(place_features(locations), start, days))
    ramp = F.least(F.col("day_number") * fixed.AOD_DAILY_STEP, F.lit(fixed.AOD_MAX_STEP))
    rows = rows.withColumn("aod_550", F.least(F.col("aod_550") + ramp, F.lit(fixed.AOD_LIMITS[1])))
    return score(rows, predict)


def forecast_summary(daily: DataFrame, location: str) -> DataFrame:
    """Per location: mean and peak PM2.5, mean index, worst day, advisory level, alert."""
    worst = F.min(F.when(F.col("pm2_5").isNotNull(), F.struct((-F.col("pm2_5")).alias("pm"), F.col("datetime").alias("at"))))
    stats = daily.groupBy(location).agg(
        F.avg("pm2_5").alias("mean_pm"), F.max("pm2_5").alias("peak_pm"), F.avg("aqi").alias("mean_aqi"), worst.alias("_worst"))
    return stats.withColumns({
        "worst_day": F.to_date("_worst.at"), "advisory_level": advisory_level("mean_pm", "forecast"),
        "alert": pollution_alert("peak_pm")}).drop("_worst")
