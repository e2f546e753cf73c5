"""PM2.5 to index, category, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .weather import _col, present


def cpcb_aqi(pm: Column | str) -> Column:
    """Index on the CPCB scale, as a double: linear inside each band, at most 500; NULL and NaN give NULL."""
    value = _col(pm)
    low, index_low = 0.0, 0.0
    index = F.when(~present(value), F.lit(None).cast("double"))
    for _, high, index_high in fixed.CPCB_BANDS[:-1]:
        line = F.lit(index_low) + (value - low) * (index_high - index_low) / (high - low)
        index = index.when(value <= high, line)
        low, index_low = high, index_high
    _, high, index_high = fixed.CPCB_BANDS[-1]
    top = F.lit(index_low) + (value - low) * (index_high - index_low) / (high - low)
    return index.when(value > low, F.least(F.lit(fixed.CPCB_INDEX_MAX), top))


def _banded(value: Column, limits: list[float], labels: list) -> Column:
    """Label of the first limit that is not exceeded; the last label has no limit; NULL and NaN have none."""
    found = F.when(~present(value), F.lit(None))
    for limit, label in zip(limits, labels):
        found = found.when(value <= limit, label)
    return found.otherwise(labels[-1])


def cpcb_category(pm: Column | str) -> Column:
    bands = fixed.CPCB_BANDS
    return _banded(_col(pm), [b[1] for b in bands[:-1]], [b[0] for b in bands])


def epa_category(pm: Column | str) -> Column:
    bands = fixed.EPA_BANDS
    return _banded(_col(pm), [b[1] for b in bands], [b[0] for b in bands] + [fixed.EPA_TOP])


def advisory_level(pm: Column | str, ladder: str = "regional") -> Column:
    """Step of a mean PM2.5 on one of the ladders regional, national, forecast: 0 up to the first limit.

    Wording is the caller's: join a table of texts on (ladder, level).
    """
    limits = fixed.ADVISORY_LIMITS[ladder]
    return _banded(_col(pm), limits, list(range(len(limits) + 1))).cast("int")


def audience_limits(pm: Column | str) -> Column:
    """Array of (audience, limited): whether the value exceeds what suits the audience."""
    value = _col(pm)
    return F.array(*[
        F.struct(F.lit(who).alias("audience"), F.when(present(value), value > limit).alias("limited"))
        for who, limit in fixed.AUDIENCE_LIMITS.items()
    ])


def category_attributes(category: Column | str, scale: str = "cpcb") -> Column:
    """Struct of colour, level, mask_needed, outdoor_limit for a category of one scale.

    ``level`` counts the scale's categories from 1; a mask is needed and time
    outdoors is limited from the level whose lower limit reaches the numeric
    limits of the audiences.  "Good" and "Moderate" stand on both scales with
    different meaning, so the scale must be named; other names give level NULL.
    """
    if scale == "cpcb":
        names, lower = [b[0] for b in fixed.CPCB_BANDS], [0.0, *[b[1] for b in fixed.CPCB_BANDS[:-1]]]
    elif scale == "epa":
        names, lower = [b[0] for b in fixed.EPA_BANDS] + [fixed.EPA_TOP], [0.0, *[b[1] for b in fixed.EPA_BANDS]]
    else:
        raise ValueError(f"unknown scale {scale!r}")
    name = _col(category)

    def lookup(values: list) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(names, values) for x in pair]), name)

    limits = fixed.AUDIENCE_LIMITS
    return F.struct(
        F.coalesce(lookup([fixed.CATEGORY_COLOURS[n] for n in names]), F.lit(fixed.UNKNOWN_COLOUR)).alias("colour"),
        lookup(list(range(1, len(names) + 1))).alias("level"),
        lookup([low >= limits["masks"] for low in lower]).alias("mask_needed"),
        lookup([low >= limits["schools"] for low in lower]).alias("outdoor_limit"),
    )


def pollution_alert(pm: Column | str) -> Column:
    return _col(pm) > fixed.ALERT_ABOVE
