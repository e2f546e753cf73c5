"""Time columns: parts, seasons, alignment, forecast dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .weather import _col

_HALF = {"hour": "30 MINUTES", "day": "12 HOURS", "minute": "30 SECONDS"}


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Hour, month and day of year of the raw (un-aligned) timestamp."""
    t = _col(ts)
    return {"hour": F.hour(t), "month": F.month(t), "day_of_year": F.dayofyear(t)}


def season(month: Column | str, scheme: str = "quarter") -> Column:
    """Season number 1-4.

    ``quarter`` uses three months each; ``monsoon`` lets season 3 run to
    September.
    """
    m = _col(month)
    groups = fixed.SEASON_MONTHS[scheme]
    label = F.when(m.isin(*groups[0]), F.lit(1))
    for number, months in enumerate(groups[1:], start=2):
        label = label.when(m.isin(*months), F.lit(number))
    return label


def align_time(ts: Column | str, unit: str = "hour") -> Column:
    """Nearest whole unit; a timestamp halfway goes up."""
    return F.date_trunc(unit, _col(ts) + F.expr(f"INTERVAL {_HALF[unit]}"))


def forecast_dates(start: Column | str, days: int) -> Column:
    """Array of ``days`` consecutive timestamps from ``start``, none for 0 days.

    Give dates through ``at_noon``; a timestamp keeps its time of day.
    """
    first = _col(start)
    if days < 1:
        return F.when(first.isNotNull(), F.array().cast("array<timestamp>"))
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: first + F.make_dt_interval(k))


def at_noon(day: Column | str) -> Column:
    return _col(day).cast("timestamp") + F.expr("INTERVAL 12 HOURS")


def iso_date(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")
