"""Explicit schemas of the tables users bring."""

from __future__ import annotations

UNIFIED = (
    "datetime timestamp, latitude double, longitude double, t2m_celsius double, "
    "wind_speed_10m double, r2m double, aod_550 double, pm2_5 double, "
    "has_ground_truth string, station_name string, hour int, month int"
)
FUSED = (
    "datetime timestamp, latitude double, longitude double, t2m double, t2m_celsius double, "
    "u10 double, v10 double, wind_speed_10m double, r2m double, blh double, sp double, "
    "hour int, month int, season string, grid_lat double, grid_lon double, grid_id string, "
    "aod_550 double, aod_470 double, angstrom_exponent double, pm2_5 double, pm10 double, "
    "no2 double, so2 double, has_ground_truth string, station_name string, "
    "lat_sin double, lat_cos double, lon_sin double, lon_cos double, season_encoded int"
)
STATIONS = (
    "datetime timestamp, station_name string, state string, city string, "
    "station_latitude double, station_longitude double, pm2_5 double, pm10 double, "
    "no2 double, so2 double, has_ground_truth string"
)
PREDICTIONS = (
    "latitude double, longitude double, predicted_pm2_5 double, health_category string, "
    "prediction_timestamp timestamp"
)
EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)
