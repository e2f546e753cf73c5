"""Location columns: grid cells, boxes, regions, encodings, labels."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .weather import _col, present


def encode_location(lat: Column | str = "latitude", lon: Column | str = "longitude") -> dict[str, Column]:
    """Sine and cosine of both coordinates, given in degrees."""
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon))
    return {"lat_cos": F.cos(phi), "lat_sin": F.sin(phi), "lon_cos": F.cos(lam), "lon_sin": F.sin(lam)}


def cell_index(c: Column | str, resolution: float) -> Column:
    """Integer number of the nearest lattice line; the exact join key of a cell."""
    return F.when(present(c), F.floor(_col(c) / F.lit(resolution) + F.lit(0.5)).cast("int"))


def grid_id(lat_index: Column | str, lon_index: Column | str, resolution: float) -> Column:
    """Printable cell name, e.g. ``13.0_77.5``; for output only, never a join key.

    Has the decimals of the resolution, so different cells have different names.
    """
    decimals = max(1, -Decimal(str(resolution)).normalize().as_tuple().exponent)
    layout = f"%.{decimals}f_%.{decimals}f"
    return F.format_string(layout, _col(lat_index) * F.lit(resolution), _col(lon_index) * F.lit(resolution))


def in_box(lat: Column | str, lon: Column | str, lat_min: float, lat_max: float,
           lon_min: float, lon_max: float) -> Column:
    """Inside a box, edges included."""
    return _col(lat).between(lat_min, lat_max) & _col(lon).between(lon_min, lon_max)


def in_zone(lat: Column | str, lon: Column | str, zone: Sequence) -> Column:
    """Inside an open-ended zone such as ``(name, '<', 70, '<', 20)``; limits excluded."""
    _, lon_side, lon_limit, lat_side, lat_limit = zone
    east_west = _col(lon) < lon_limit if lon_side == "<" else _col(lon) > lon_limit
    north_south = _col(lat) < lat_limit if lat_side == "<" else _col(lat) > lat_limit
    return east_west & north_south


def location_status(lat: Column | str = "latitude", lon: Column | str = "longitude",
                    bounds: dict[str, float] | None = None) -> Column:
    """``outside`` the bounds, else ``ocean``, else ``valid``; ``unknown`` without a position."""
    inside = in_box(lat, lon, **(bounds or fixed.VALIDATION_BOUNDS))
    at_sea = F.lit(False)
    for zone in fixed.OCEAN_ZONES:
        at_sea = at_sea | in_zone(lat, lon, zone)
    return F.when(~present(lat, lon), "unknown").when(~inside, "outside").when(at_sea, "ocean").otherwise("valid")


def region_of(lat: Column | str = "latitude", lon: Column | str = "longitude") -> Column:
    """Named region of a point: first matching city box, else a part of the country; NULL without a position."""
    y, x = _col(lat), _col(lon)
    label = F.when(~present(y, x), F.lit(None).cast("string"))
    for name, *box in fixed.REGION_BOXES:
        label = label.when(in_box(y, x, *box), name)
    return (
        label.when(y >= fixed.NORTH_FROM_LAT, fixed.REGION_PARTS["north"])
        .when(x <= fixed.WEST_TO_LON, fixed.REGION_PARTS["west"])
        .when(x >= fixed.EAST_FROM_LON, fixed.REGION_PARTS["east"])
        .when(y.between(*fixed.CENTRAL_LAT), fixed.REGION_PARTS["central"])
        .otherwise(fixed.REGION_PARTS["rest"])
    )


def zone_baseline(lat: Column | str = "latitude", lon: Column | str = "longitude") -> Column:
    """Struct of the climatological base values that hold at a point; NULL without a position."""

    def base(name: str, aod: float, wind: float, blh: float) -> Column:
        return F.struct(
            F.lit(name).alias("zone"), F.lit(aod).alias("aod_base"),
            F.lit(wind).alias("wind_base"), F.lit(blh).alias("blh_base"),
        )

    found = F
    for name, lat_min, lat_max, lon_min, lon_max, *values in fixed.BASELINE_ZONES:
        found = found.when(in_box(lat, lon, lat_min, lat_max, lon_min, lon_max), base(name, *values))
    return F.when(present(lat, lon), found.otherwise(base(*fixed.DEFAULT_ZONE)))


def coord_label(lat: Column | str = "latitude", lon: Column | str = "longitude") -> Column:
    """Coordinates for display, e.g. ``28.61°N, 77.21°E``."""
    return F.format_string("%.2f°N, %.2f°E", _col(lat), _col(lon))
