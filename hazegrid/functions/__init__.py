"""Column functions: every one maps columns to a column and stays in generated code."""

from .calendar import align_time, at_noon, calendar_parts, forecast_dates, iso_date, season
from .geo import (
    cell_index, coord_label, encode_location, grid_id, in_box, location_status,
    region_of, zone_baseline,
)
from .health import (
    advisory_level, audience_limits, category_attributes, cpcb_aqi, cpcb_category,
    epa_category, pollution_alert,
)
from .weather import (
    clamp, estimate_blh, fallback_pm25, formula_pm25, kelvin_to_celsius, present, wind_speed,
)

__all__ = [
    "advisory_level", "align_time", "at_noon", "audience_limits", "calendar_parts", "category_attributes",
    "cell_index", "clamp", "coord_label", "cpcb_aqi", "cpcb_category", "encode_location",
    "epa_category", "estimate_blh", "fallback_pm25", "forecast_dates", "formula_pm25",
    "grid_id", "in_box", "iso_date", "kelvin_to_celsius", "location_status",
    "pollution_alert", "present", "region_of", "season", "wind_speed", "zone_baseline",
]
