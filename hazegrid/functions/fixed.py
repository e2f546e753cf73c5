"""Fixed values of the air-quality domain.

Everything in this module is a constant that results depend on: limits,
breakpoints, coordinates, colours.  Logic lives elsewhere.
"""

from __future__ import annotations

# --- Fixed values: national bounds and excluded zones -----------------------
NATIONAL_BOUNDS = {"lat_min": 8.0, "lat_max": 37.0, "lon_min": 68.0, "lon_max": 97.0}
VALIDATION_BOUNDS = {"lat_min": 8.0, "lat_max": 37.0, "lon_min": 68.0, "lon_max": 97.25}
# name, longitude side and limit, latitude side and limit; both comparisons strict
EXCLUSION_ZONES = [
    ("arabian_sea", "<", 70.0, "<", 20.0),
    ("bay_of_bengal", ">", 90.0, "<", 15.0),
    ("north_west", "<", 74.0, ">", 28.0),
    ("north_east", ">", 95.0, ">", 28.0),
]
OCEAN_ZONES = EXCLUSION_ZONES[:2]

# --- Fixed values: cities (name, latitude, longitude, population in millions)
CITIES = [
    ("Delhi", 28.6139, 77.2090, 32),
    ("Mumbai", 19.0760, 72.8777, 21),
    ("Bangalore", 12.9716, 77.5946, 13),
    ("Kolkata", 22.5726, 88.3639, 15),
    ("Chennai", 13.0827, 80.2707, 11),
    ("Hyderabad", 17.3850, 78.4867, 10),
    ("Ahmedabad", 23.0225, 72.5714, 8),
    ("Pune", 18.5204, 73.8567, 7),
    ("Jaipur", 26.9124, 75.7873, 4),
    ("Kochi", 9.9312, 76.2673, 2),
]

# --- Fixed values: region boxes (name, lat min, lat max, lon min, lon max), first match wins
REGION_BOXES = [
    ("Delhi NCR", 28.3, 28.9, 76.8, 77.8),
    ("Mumbai", 18.9, 19.3, 72.7, 73.2),
    ("Bangalore", 12.8, 13.2, 77.4, 77.8),
    ("Kolkata", 22.4, 22.8, 88.2, 88.5),
    ("Chennai", 12.9, 13.2, 80.1, 80.4),
    ("Hyderabad", 17.2, 17.6, 78.2, 78.7),
    ("Ahmedabad", 22.9, 23.3, 72.4, 72.8),
    ("Pune", 18.4, 18.7, 73.7, 74.0),
    ("Jaipur", 26.8, 27.0, 75.6, 76.0),
    ("Lucknow", 26.7, 26.9, 80.8, 81.1),
    ("Kanpur", 26.3, 26.6, 80.2, 80.5),
    ("Nagpur", 21.0, 21.3, 78.9, 79.2),
    ("Patna", 25.5, 25.7, 85.0, 85.3),
    ("Indore", 22.6, 22.8, 75.7, 76.0),
    ("Bhopal", 23.1, 23.4, 77.3, 77.6),
    ("Visakhapatnam", 17.6, 17.8, 83.1, 83.4),
    ("Vadodara", 22.2, 22.4, 73.0, 73.3),
    ("Ludhiana", 30.8, 31.0, 75.7, 76.0),
    ("Agra", 27.1, 27.3, 77.9, 78.2),
    ("Nashik", 19.9, 20.1, 73.6, 73.9),
]
REGION_PARTS = {"north": "Northern India", "west": "Western India", "east": "Eastern India",
                "central": "Central India", "rest": "Southern India"}
NORTH_FROM_LAT = 26.0
WEST_TO_LON = 76.0
EAST_FROM_LON = 86.0
CENTRAL_LAT = (18.0, 26.0)

# --- Fixed values: baseline zones (name, lat min, lat max, lon min, lon max, AOD, wind, boundary layer)
BASELINE_ZONES = [
    ("delhi", 28.0, 29.0, 76.5, 77.5, 0.8, 3.0, 600.0),
    ("mumbai", 18.8, 19.3, 72.7, 73.2, 0.6, 5.0, 900.0),
    ("bangalore", 12.8, 13.2, 77.4, 77.8, 0.5, 4.0, 1000.0),
    ("kolkata", 22.3, 22.8, 88.2, 88.5, 0.7, 3.5, 700.0),
]
DEFAULT_ZONE = ("other", 0.6, 4.0, 800.0)

# --- Fixed values: seasons --------------------------------------------------
# months of seasons 1 to 4 under each scheme
SEASON_MONTHS = {
    "quarter": [(12, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11)],
    "monsoon": [(12, 1, 2), (3, 4, 5), (6, 7, 8, 9), (10, 11)],
}
# base temperature and humidity of seasons 1 to 4
SEASON_BASE = [(15.0, 70.0), (25.0, 60.0), (30.0, 85.0), (20.0, 65.0)]

# --- Fixed values: physical limits (low, high) ------------------------------
PM_LIMITS = (5.0, 500.0)
PM_LIMITS_SEASONAL = (5.0, 250.0)
AOD_LIMITS = (0.1, 2.0)
HUMIDITY_LIMITS = (30.0, 95.0)
WIND_MIN = 0.5
BLH_MIN = 200.0
KELVIN_OFFSET = 273.15
AOD_DAILY_STEP, AOD_MAX_STEP = 0.1, 0.3
FALLBACK_PM_PER_AOD = 120.0

# --- Fixed values: formula coefficients --------------------------------------
BLH_ESTIMATE = (500.0, 20.0, 100.0)  # base, per degree, spread
LINEAR_PM25 = {"aod": 80.0, "temp": 0.5, "temp_from": 40.0, "wind": 2.0, "wind_from": 10.0, "r2m": 0.2,
               "blh": 0.02, "blh_from": 1000.0}
SEASONAL_PM25 = {"base": 30.0, "yearly": 15.0, "month_from": 3, "aod": 70.0, "wind": 3.0, "temp": 0.5}

# --- Fixed values: defaults of absent scoring inputs ------------------------
FEATURE_DEFAULTS = {
    "aod_550": 0.6, "t2m_celsius": 25.0, "wind_speed_10m": 4.0, "r2m": 65.0, "blh": 800.0,
    "latitude": 28.6, "longitude": 77.2, "hour": 12, "month": 6, "season": 2,
}

# --- Fixed values: CPCB scale (category, PM2.5 upper limit, index at the limit);
# the last line is the slope's end point, reached as 100 index points per 130
CPCB_BANDS = [
    ("Good", 30.0, 50.0),
    ("Satisfactory", 60.0, 100.0),
    ("Moderate", 90.0, 200.0),
    ("Poor", 120.0, 300.0),
    ("Very Poor", 250.0, 400.0),
    ("Severe", 380.0, 500.0),
]
CPCB_INDEX_MAX = 500.0

# --- Fixed values: EPA-style scale (category, PM2.5 upper limit) ------------
EPA_BANDS = [
    ("Good", 12.0),
    ("Moderate", 35.5),
    ("Unhealthy for Sensitive Groups", 55.4),
    ("Unhealthy", 150.4),
    ("Very Unhealthy", 250.4),
]
EPA_TOP = "Hazardous"
UNHEALTHY_ABOVE = 55.4
ALERT_ABOVE = 120.0

# --- Fixed values: category colours -----------------------------------------
CATEGORY_COLOURS = {
    "Good": "#00e400",
    "Satisfactory": "#ffff00",
    "Moderate": "#ff7e00",
    "Poor": "#ff0000",
    "Very Poor": "#8f3f97",
    "Severe": "#7e0023",
    "Unhealthy for Sensitive Groups": "#ff7e00",
    "Unhealthy": "#ff0000",
    "Very Unhealthy": "#8f3f97",
    "Hazardous": "#7e0023",
}
UNKNOWN_COLOUR = "#808080"

# --- Fixed values: severity bands of CPCB categories ------------------------
SEVERITY_BANDS = {
    "good": ["Good"],
    "moderate": ["Satisfactory", "Moderate"],
    "poor": ["Poor", "Very Poor", "Severe"],
}

# --- Fixed values: limits of the advisory ladders (upper limits, inclusive) -
ADVISORY_LIMITS = {
    "regional": [30.0, 60.0, 90.0, 120.0],
    "national": [12.0, 35.0, 55.0],
    "forecast": [30.0, 60.0, 90.0],
}
AUDIENCE_LIMITS = {"exercise": 35.0, "schools": 55.0, "vulnerable": 12.0, "masks": 35.0}

# --- Fixed values: substrings that assign columns to variable groups --------
QUALITY_GROUPS = {
    "Weather": ["t2m", "wind", "blh", "humidity", "pressure"],
    "AOD": ["aod"],
    "Ground Truth": ["pm2_5", "pm10", "no2"],
    "Spatial/Temporal": ["lat", "lon", "hour", "month"],
}
SOURCE_MARKERS = {"weather": ["t2m", "wind"], "satellite_aod": ["aod"], "ground": ["pm2_5", "pm10", "no2"]}

# --- Fixed values: model settings -------------------------------------------
SEED = 42
TRAIN_FRACTION = 0.7
FOREST_SETTINGS = {"trees": 100, "depth": 10}
BOOSTED_SETTINGS = {
    "base": {"rounds": 100, "depth": 6, "rate": 0.1, "row_share": 1.0, "column_share": 1.0},
    "retrain": {"rounds": 300, "depth": 3, "rate": 0.1, "row_share": 0.9, "column_share": 0.9},
    "formula": {"rounds": 200, "depth": 4, "rate": 0.1, "row_share": 0.8, "column_share": 0.8},
}
FOREST_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 15, 20, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}
BOOSTED_GRID = {
    "maxIter": [100, 200, 300],
    "maxDepth": [3, 6, 9],
    "stepSize": [0.01, 0.1, 0.2],
    "subsamplingRate": [0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.8", "0.9", "1.0"],
}
