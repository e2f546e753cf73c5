"""Row filters; every predicate is a plain column expression, so Catalyst pushes what it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, in_box, present
from ..functions.geo import in_zone


def require_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a value of the target; NaN counts as none."""
    return complete_cases(df, [target])


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete in all columns."""
    return df.na.drop("any", subset=list(columns))


def filter_category(df: DataFrame, column: str, category: str | None = None) -> DataFrame:
    """Rows of one category; no category keeps all rows."""
    return df if category is None else df.where(F.col(column) == category)


def filter_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows in a closed range; an open end is the column's own limit, so NULLs always go."""
    kept = F.col(column).isNotNull()
    if low is not None:
        kept = kept & (F.col(column) >= low)
    if high is not None:
        kept = kept & (F.col(column) <= high)
    return df.where(kept)


def within_bounds(df: DataFrame, bounds: Mapping[str, float] | None = None,
                  lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside a box, edges included."""
    return df.where(in_box(lat, lon, **(bounds or fixed.NATIONAL_BOUNDS)))


def exclude_zones(df: DataFrame, zones: Sequence[Sequence] | None = None,
                  lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows outside all zones; a row without a position is in none and goes."""
    kept = present(lat, lon)
    for zone in fixed.EXCLUSION_ZONES if zones is None else zones:
        kept = kept & ~in_zone(lat, lon, zone)
    return df.where(kept)


def with_ground_truth(df: DataFrame, flag: str = "has_ground_truth") -> DataFrame:
    return df.where(F.col(flag))


def category_in(column: str, categories: Sequence[str]) -> Column:
    return F.col(column).isin(*categories)
