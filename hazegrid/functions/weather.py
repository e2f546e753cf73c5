"""Weather-derived columns and model-free PM2.5 estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(*columns: Column | str) -> Column:
    """True where every column holds a number: neither NULL nor NaN."""
    found = F.lit(True)
    for c in columns:
        value = _col(c).cast("double")
        found = found & value.isNotNull() & ~F.isnan(value)
    return F.coalesce(found, F.lit(False))


def clamp(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to [low, high]; NULL and NaN give NULL."""
    value = _col(c)
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(present(value), bounded)


def kelvin_to_celsius(c: Column | str) -> Column:
    return _col(c) - F.lit(fixed.KELVIN_OFFSET)


def wind_speed(u: Column | str, v: Column | str) -> Column:
    """Length of the wind vector."""
    return F.hypot(_col(u), _col(v))


def estimate_blh(t2m_celsius: Column | str) -> Column:
    """Boundary-layer height from temperature.

    The spread of 0..100 m on top of the base enters with its mean, so that
    equal rows get equal values wherever and whenever they are computed.
    """
    base, slope, spread = fixed.BLH_ESTIMATE
    return F.lit(base) + F.lit(slope) * _col(t2m_celsius) + F.lit(spread / 2)


def formula_pm25(variant: str = "linear", limit: bool = True) -> Column:
    """Closed-form PM2.5 estimate from the feature columns.

    ``linear`` needs AOD, temperature, wind, humidity and boundary-layer
    height; ``seasonal`` needs month, AOD, wind and temperature.
    """
    aod, temp, wind = F.col("aod_550"), F.col("t2m_celsius"), F.col("wind_speed_10m")
    if variant == "linear":
        k = fixed.LINEAR_PM25
        raw = (
            aod * k["aod"]
            + (F.lit(k["temp_from"]) - temp) * k["temp"]
            + (F.lit(k["wind_from"]) - wind) * k["wind"]
            + F.col("r2m") * k["r2m"]
            + (F.lit(k["blh_from"]) - F.col("blh")) * k["blh"]
        )
        limits = fixed.PM_LIMITS
    elif variant == "seasonal":
        k = fixed.SEASONAL_PM25
        yearly = F.sin((F.col("month") - k["month_from"]) * F.pi() / 6)
        raw = F.lit(k["base"]) - yearly * k["yearly"] + aod * k["aod"] - wind * k["wind"] + temp * k["temp"]
        limits = fixed.PM_LIMITS_SEASONAL
    else:
        raise ValueError(f"unknown formula variant {variant!r}")
    return clamp(raw, *limits) if limit else raw


def fallback_pm25(prediction: Column | str, aod: Column | str) -> Column:
    """The prediction, or an AOD-proportional estimate where there is none."""
    by_aod = clamp(_col(aod) * fixed.FALLBACK_PM_PER_AOD, *fixed.PM_LIMITS)
    return F.coalesce(_col(prediction), by_aod)
