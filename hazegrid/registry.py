"""Registered queries over the given tables, each beside an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import (
    advisory_level, align_time, audience_limits, calendar_parts, category_attributes, cell_index, clamp, coord_label,
    cpcb_aqi, cpcb_category, encode_location, epa_category, estimate_blh, fallback_pm25, fixed, formula_pm25, grid_id,
    iso_date, kelvin_to_celsius, location_status, pollution_alert, region_of, season, wind_speed, zone_baseline,
)
from .functions import sql as sql_functions
from .operators import checks, filters, ranking, sketches, stats
from .plans import forecast, fusion, models
from .session import scratch_path, stored
from .sources import readers, views, writers
from .streaming import readings as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- SQL of the views ----------------------------------------------------------

_CITY = ", ".join(f"({i}, '{n}', {lat}e0, {lon}e0, {pop})" for i, (n, lat, lon, pop) in enumerate(fixed.CITIES))
_BASE = f"""
WITH city(i, name, clat, clon, pop) AS (VALUES {_CITY}),
locations AS (
  SELECT user_id AS station_id,
    CASE WHEN user_id % 2 = 0 THEN clat + ((user_id % 7) - 3) / 2e1 ELSE 8 + ((user_id * 37) % 290) / 1e1 END AS latitude,
    CASE WHEN user_id % 2 = 0 THEN clon + ((user_id % 5) - 2) / 2e1 ELSE 68 + ((user_id * 53) % 289) / 1e1 END AS longitude
  FROM (SELECT DISTINCT user_id FROM events) u JOIN city ON i = (user_id // 2) % 10),
readings AS (
  SELECT event_id, ts AS datetime, user_id AS station_id, value AS pm2_5, event_type AS kind,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, latitude, longitude
  FROM events JOIN locations ON station_id = user_id),
cells AS (
  SELECT *, CAST(floor(latitude / 0.5e0 + 0.5e0) AS INT) AS cell_lat, CAST(floor(longitude / 0.5e0 + 0.5e0) AS INT) AS cell_lon
  FROM readings),
fused AS (
  SELECT printf('%.1f_%.1f', cell_lat * 0.5e0, cell_lon * 0.5e0) AS grid_id, cell_lat, cell_lon, date_trunc('day', datetime) AS datetime,
    cell_lat * 0.5e0 AS latitude, cell_lon * 0.5e0 AS longitude,
    avg(CASE WHEN kind = 'purchase' THEN pm2_5 END) AS pm2_5,
    avg(CASE WHEN kind = 'view' THEN pm2_5 / 500 END) AS aod_550,
    avg(CASE WHEN kind = 'signup' THEN pm2_5 % 45 END) AS t2m_celsius,
    avg(CASE WHEN kind = 'click' THEN pm2_5 % 12 END) AS wind_speed_10m,
    avg(CASE WHEN kind = 'error' THEN pm2_5 % 100 END) AS r2m
  FROM cells GROUP BY ALL),
truth AS (SELECT *, pm2_5 IS NOT NULL AS has_ground_truth FROM fused),
regr AS (
  SELECT *, aod_550 * 80 + (40 - t2m_celsius) * 0.5e0 + (10 - wind_speed_10m) * 2 + r2m * 0.2e0 + (1000 - blh) * 0.02e0 + l_extendedprice % 10 AS pm2_5
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount * 8 AS aod_550, l_quantity % 45 AS t2m_celsius,
    1 + l_tax * 100 AS wind_speed_10m, CAST(30 + p_size AS DOUBLE) AS r2m, 300 + l_quantity * 10 AS blh, month(l_shipdate) AS month, CAST(l_shipdate AS DATE) AS day
    FROM lineitem JOIN part ON l_partkey = p_partkey) x)
"""


def _sql_aqi(v: str) -> str:
    out, low, index_low = "CASE", 0.0, 0.0
    for _, high, index_high in fixed.CPCB_BANDS[:-1]:
        out += f" WHEN {v} <= {high}e0 THEN {index_low}e0 + ({v} - {low}e0) * {index_high - index_low}e0 / {high - low}e0"
        low, index_low = high, index_high
    _, high, index_high = fixed.CPCB_BANDS[-1]
    return out + f" WHEN {v} > {low}e0 THEN least(500e0, {index_low}e0 + ({v} - {low}e0) * {index_high - index_low}e0 / {high - low}e0) END"


def _sql_bands(v: str, limits: list[float], labels: list) -> str:
    def lit(x) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x)
    return "CASE " + " ".join(f"WHEN {v} <= {limit}e0 THEN {lit(label)}" for limit, label in zip(limits, labels)) + (
        f" WHEN {v} IS NOT NULL THEN {lit(labels[-1])} END")


def _sql_cpcb(v: str) -> str:
    return _sql_bands(v, [b[1] for b in fixed.CPCB_BANDS[:-1]], [b[0] for b in fixed.CPCB_BANDS])


def _sql_epa(v: str) -> str:
    return _sql_bands(v, [b[1] for b in fixed.EPA_BANDS], [b[0] for b in fixed.EPA_BANDS] + [fixed.EPA_TOP])


def _sql_ladder(v: str, ladder: str) -> str:
    limits = fixed.ADVISORY_LIMITS[ladder]
    return _sql_bands(v, limits, list(range(len(limits) + 1)))


def _sql_box(lat_min, lat_max, lon_min, lon_max) -> str:
    return f"latitude BETWEEN {lat_min}e0 AND {lat_max}e0 AND longitude BETWEEN {lon_min}e0 AND {lon_max}e0"


def _sql_zone(zone) -> str:
    _, a, x, b, y = zone
    return f"(longitude {a} {x}e0 AND latitude {b} {y}e0)"


_SQL_BOUNDS = _sql_box(8.0, 37.0, 68.0, 97.0)
_SQL_LAND = "NOT (" + " OR ".join(_sql_zone(z) for z in fixed.EXCLUSION_ZONES) + ")"
_SQL_REGION = "CASE " + " ".join(f"WHEN {_sql_box(*box)} THEN '{name}'" for name, *box in fixed.REGION_BOXES) + (
    " WHEN latitude >= 26 THEN 'Northern India' WHEN longitude <= 76 THEN 'Western India' WHEN longitude >= 86 THEN 'Eastern India'"
    " WHEN latitude BETWEEN 18 AND 26 THEN 'Central India' ELSE 'Southern India' END")


def _sql_zone_value(k: int) -> str:
    def lit(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}e0"
    return "CASE " + " ".join(
        f"WHEN {_sql_box(*z[1:5])} THEN {lit((z[0], *z[5:])[k])}" for z in fixed.BASELINE_ZONES) + f" ELSE {lit(fixed.DEFAULT_ZONE[k])} END"


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_FMT = "'%Y-%m-%d %H:%M:%S'"


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") and "locations AS" in sql else _BASE + sql
        return run
    return add


_V = views
_GROUPS = ["purchase", "view"]

# --- A: sources and sinks --------------------------------------------------------

query("scan_readings", "SELECT event_id, station_id, kind, k, pm2_5 FROM readings WHERE pm2_5 > 5")(
    lambda s, d: _V.readings(s, d).where("pm2_5 > 5").select("event_id", "station_id", "kind", "k", "pm2_5"))


@query("first_available", "SELECT count(*) AS rows FROM events WHERE value IS NOT NULL")
def _first_available(s, d):
    _, df = readers.first_available(s, [f"{d}/absent.parquet", f"{d}/nation.parquet", f"{d}/events.parquet"], ["value"])
    return df.where("value IS NOT NULL").agg(F.count("*").alias("rows"))


@query("latest_snapshot", "SELECT event_id, pm2_5 FROM readings WHERE CAST(datetime AS DATE) = (SELECT max(CAST(datetime AS DATE)) FROM readings)")
def _latest_snapshot(s, d):
    return readers.latest_snapshot(_V.readings(s, d).withColumn("day", F.to_date("datetime")), "day").select("event_id", "pm2_5")


@query("schema_contract", f"SELECT event_id, pm2_5 AS predicted_pm2_5, {_sql_epa('pm2_5')} AS health_category FROM readings")
def _schema_contract(s, d):
    return readers.ensure_columns(
        _V.predictions(s, d), ["latitude", "longitude", "predicted_pm2_5"],
        {"health_category": epa_category("predicted_pm2_5")}).select("event_id", "predicted_pm2_5", "health_category")


@query("roundtrip_sink", "SELECT event_id, kind, pm2_5, k FROM readings")
def _roundtrip(s, d):
    path = writers.write_table(_V.readings(s, d).select("event_id", "kind", "pm2_5", "k"), scratch_path(s, "sink"), partition_by=["kind"])
    return s.read.schema("event_id long, pm2_5 double, k int, kind string").parquet(path)


_LINEAR = "80 * aod_550 + 0.5e0 * (40 - t2m_celsius) + 2 * (10 - wind_speed_10m) + 0.2e0 * r2m + 0.02e0 * (1000 - blh)"
_SEASONAL = "30 - 15 * sin((month - 3) * pi() / 6) + 70 * aod_550 - 3 * wind_speed_10m + 0.5e0 * t2m_celsius"


def _clamped(v: str, low: float, high: float) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN greatest({low}e0, least({high}e0, {v})) END"


def _predicted(s, d) -> DataFrame:
    return _V.regr(s, d).withColumn("predicted", formula_pm25("linear"))


@query("metrics_document", f"""SELECT 'formula' AS name, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
  round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS total_samples, 5 AS n_features
  FROM (SELECT pm2_5 AS y, pm2_5 - ({_clamped(_LINEAR, 5, 500)}) AS e FROM regr)""")
def _metrics_document(s, d):
    metrics = stats.regression_metrics(_predicted(s, d), "pm2_5", "predicted")
    doc = writers.metrics_document(metrics, "formula", _V.REGR_FEATURES, {"high": 500.0})
    path = writers.write_document(doc, scratch_path(s, "document"))
    back = s.read.schema(doc.schema).json(path)
    return back.select("best_model.name", _r("best_model.mae").alias("mae"), _r("best_model.rmse").alias("rmse"),
                       _r("best_model.r2").alias("r2"), "dataset_info.total_samples",
                       F.size("dataset_info.features_used").alias("n_features"))


_FUSED_COLS = ["grid_id", "datetime", "latitude", "longitude", "pm2_5", "aod_550", "t2m_celsius", "wind_speed_10m", "r2m"]


def _fused(s, d) -> DataFrame:
    return _V.fused(s, d).select(*_FUSED_COLS)


@query("quality_report", "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT 'size' AS section, '{k}' AS item, round(CAST({v} AS DOUBLE), 6) AS value FROM fused" for k, v in
     (("records", "count(*)"), ("cells", "count(DISTINCT grid_id)"), ("times", "count(DISTINCT datetime)"))]
    + [f"SELECT 'extent', '{n}_{m}', round({m}({c}), 6) FROM fused" for n, c in (("lat", "latitude"), ("lon", "longitude")) for m in ("min", "max")]
    + [f"SELECT 'missing', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM fused" for c in _FUSED_COLS]) + ") WHERE section <> 'missing' OR value > 0")
def _quality_report(s, d):
    return _rounded(stats.quality_report(_fused(s, d)), "value")


query("grid_reference", "SELECT DISTINCT grid_id, latitude, longitude FROM fused")(
    lambda s, d: _V.fused(s, d).select("grid_id", "latitude", "longitude").dropDuplicates())

# --- B: filters -------------------------------------------------------------------

query("filter_target", "SELECT grid_id, round(pm2_5, 6) AS pm2_5 FROM fused WHERE pm2_5 IS NOT NULL")(
    lambda s, d: _rounded(filters.require_target(_V.fused(s, d), "pm2_5").select("grid_id", "pm2_5"), "pm2_5"))
query("complete_cases", "SELECT grid_id, round(pm2_5, 6) AS pm2_5, round(r2m, 6) AS r2m FROM fused WHERE pm2_5 IS NOT NULL AND aod_550 IS NOT NULL AND t2m_celsius IS NOT NULL AND wind_speed_10m IS NOT NULL AND r2m IS NOT NULL")(
    lambda s, d: _rounded(filters.complete_cases(_V.fused(s, d), _FUSED_COLS[4:]).select("grid_id", "pm2_5", "r2m"), "pm2_5", "r2m"))
query("filter_category", f"SELECT event_id, pm2_5 FROM readings WHERE {_sql_cpcb('pm2_5')} = 'Poor'")(
    lambda s, d: filters.filter_category(_V.readings(s, d).withColumn("c", cpcb_category("pm2_5")), "c", "Poor").select("event_id", "pm2_5"))
query("filter_range", "SELECT event_id, pm2_5 FROM readings WHERE pm2_5 BETWEEN 35.5e0 AND 150.4e0")(
    lambda s, d: filters.filter_range(_V.readings(s, d), "pm2_5", 35.5, 150.4).select("event_id", "pm2_5"))
query("filter_bbox", f"SELECT event_id FROM readings WHERE {_sql_box(10.0, 35.0, 70.0, 95.0)}")(
    lambda s, d: filters.within_bounds(_V.readings(s, d), {"lat_min": 10.0, "lat_max": 35.0, "lon_min": 70.0, "lon_max": 95.0}).select("event_id"))
query("filter_land", f"SELECT event_id FROM readings WHERE {_SQL_LAND}")(
    lambda s, d: filters.exclude_zones(_V.readings(s, d)).select("event_id"))
query("location_status", f"SELECT station_id, CASE WHEN NOT ({_sql_box(10.0, 35.0, 70.0, 95.0)}) THEN 'outside' WHEN {' OR '.join(_sql_zone(z) for z in fixed.OCEAN_ZONES)} THEN 'ocean' ELSE 'valid' END AS status FROM locations")(
    lambda s, d: _V.locations(s, d).select("station_id", location_status(bounds={"lat_min": 10.0, "lat_max": 35.0, "lon_min": 70.0, "lon_max": 95.0}).alias("status")))
query("filter_ground_truth", "SELECT grid_id, round(pm2_5, 6) AS pm2_5 FROM truth WHERE has_ground_truth")(
    lambda s, d: _rounded(filters.with_ground_truth(_V.fused(s, d)).select("grid_id", "pm2_5"), "pm2_5"))
query("severe_membership", f"SELECT event_id FROM readings WHERE {_sql_cpcb('pm2_5')} IN ('Poor', 'Very Poor', 'Severe')")(
    lambda s, d: _V.readings(s, d).withColumn("c", cpcb_category("pm2_5")).where(filters.category_in("c", fixed.SEVERITY_BANDS["poor"])).select("event_id"))

# --- C: columns -------------------------------------------------------------------

query("weather_features", "SELECT event_id, round(pm2_5 + 200 - 273.15e0, 9) AS celsius, round(sqrt(pm2_5 * pm2_5 + CAST(k AS DOUBLE) * k), 9) AS wind FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", _r(kelvin_to_celsius(F.col("pm2_5") + 200), 9).alias("celsius"), _r(wind_speed(F.col("pm2_5"), F.col("k")), 9).alias("wind")))
query("location_encoding", "SELECT station_id, " + ", ".join(f"round({f}(radians({c})), 9) AS {n}_{f}" for n, c in (("lat", "latitude"), ("lon", "longitude")) for f in ("cos", "sin")) + " FROM locations")(
    lambda s, d: _V.locations(s, d).select("station_id", *[_r(c, 9).alias(n) for n, c in encode_location().items()]))


def _sql_season(m: str, scheme: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} IN {months} THEN {n}" for n, months in enumerate(fixed.SEASON_MONTHS[scheme], 1)) + " END"


query("season_features", f"SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, CAST(dayofyear(o_orderdate) AS INT) AS day_of_year, {_sql_season('month(o_orderdate)', 'quarter')} AS quarter, {_sql_season('month(o_orderdate)', 'monsoon')} AS monsoon FROM orders")(
    lambda s, d: _V.table(s, d, "orders").select("o_orderkey", calendar_parts("o_orderdate")["month"].alias("month"), calendar_parts("o_orderdate")["day_of_year"].alias("day_of_year"), season(F.month("o_orderdate")).alias("quarter"), season(F.month("o_orderdate"), "monsoon").alias("monsoon")))
query("blh_estimate", "SELECT event_id, round(550 + 20 * (pm2_5 % 45), 6) AS blh FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", _r(estimate_blh(F.col("pm2_5") % 45)).alias("blh")))
query("grid_snap", "SELECT station_id, CAST(floor(latitude / 0.5e0 + 0.5e0) AS INT) AS cell_lat, CAST(floor(longitude / 0.5e0 + 0.5e0) AS INT) AS cell_lon, printf('%.1f_%.1f', floor(latitude / 0.5e0 + 0.5e0) * 0.5e0, floor(longitude / 0.5e0 + 0.5e0) * 0.5e0) AS grid_id FROM locations")(
    lambda s, d: fusion.snap(_V.locations(s, d), 0.5).select("station_id", "cell_lat", "cell_lon", grid_id("cell_lat", "cell_lon", 0.5).alias("grid_id")))
query("time_align", f"SELECT event_id, strftime(date_trunc('hour', datetime + INTERVAL 30 MINUTE), {_FMT}) AS hour FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", F.date_format(align_time("datetime"), "yyyy-MM-dd HH:mm:ss").alias("hour")))
query("clamp_values", f"SELECT grid_id, round({_clamped('pm2_5', 5, 250)}, 6) AS pm, round({_clamped('r2m', 30, 95)}, 6) AS r2m FROM fused")(
    lambda s, d: _V.fused(s, d).select("grid_id", _r(clamp("pm2_5", 5.0, 250.0)).alias("pm"), _r(clamp("r2m", 30.0, 95.0)).alias("r2m")))
query("cpcb_aqi", f"SELECT event_id, round({_sql_aqi('pm2_5')}, 6) AS aqi, CAST(trunc({_sql_aqi('pm2_5')}) AS INT) AS aqi_int, {_sql_cpcb('pm2_5')} AS category FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", _r(cpcb_aqi("pm2_5")).alias("aqi"), cpcb_aqi("pm2_5").cast("int").alias("aqi_int"), cpcb_category("pm2_5").alias("category")))
query("epa_category", f"SELECT event_id, {_sql_epa('pm2_5')} AS category FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", epa_category("pm2_5").alias("category")))


def _sql_attributes(category: str, scale: str) -> str:
    if scale == "cpcb":
        names, lower = [b[0] for b in fixed.CPCB_BANDS], [0.0, *[b[1] for b in fixed.CPCB_BANDS[:-1]]]
    else:
        names, lower = [b[0] for b in fixed.EPA_BANDS] + [fixed.EPA_TOP], [0.0, *[b[1] for b in fixed.EPA_BANDS]]
    def case(values):
        return "CASE " + " ".join(f"WHEN {category} = '{n}' THEN {v}" for n, v in zip(names, values)) + " END"
    colours = ["'" + fixed.CATEGORY_COLOURS[n] + "'" for n in names]
    return (f"{case(colours)} AS {scale}_colour, {case(range(1, 99))} AS {scale}_level, "
            f"{case([low >= 35 for low in lower])} AS {scale}_mask, {case([low >= 55 for low in lower])} AS {scale}_outdoor")


@query("category_enriched", f"SELECT event_id, {_sql_attributes(_sql_cpcb('pm2_5'), 'cpcb')}, {_sql_attributes(_sql_epa('pm2_5'), 'epa')} FROM readings")
def _category_enriched(s, d):
    out = [F.col("event_id")]
    for scale, category in (("cpcb", cpcb_category("pm2_5")), ("epa", epa_category("pm2_5"))):
        a = category_attributes(category, scale)
        out += [a["colour"].alias(f"{scale}_colour"), a["level"].alias(f"{scale}_level"),
                a["mask_needed"].alias(f"{scale}_mask"), a["outdoor_limit"].alias(f"{scale}_outdoor")]
    return _V.readings(s, d).select(*out)


@query("advisory_levels", "SELECT event_id, " + ", ".join(f"{_sql_ladder('pm2_5', n)} AS {n}" for n in fixed.ADVISORY_LIMITS)
       + ", " + ", ".join(f"pm2_5 > {v} AS {n}" for n, v in fixed.AUDIENCE_LIMITS.items()) + " FROM readings")
def _advisory_levels(s, d):
    limited = audience_limits("pm2_5")
    return _V.readings(s, d).select(
        "event_id", *[advisory_level("pm2_5", n).alias(n) for n in fixed.ADVISORY_LIMITS],
        *[limited[i]["limited"].alias(n) for i, n in enumerate(fixed.AUDIENCE_LIMITS)])


query("region_label", f"SELECT station_id, {_SQL_REGION} AS region FROM locations")(
    lambda s, d: _V.locations(s, d).select("station_id", region_of().alias("region")))
query("zone_baseline", "SELECT station_id, " + ", ".join(f"{_sql_zone_value(k)} AS {n}" for k, n in enumerate(("zone", "aod_base", "wind_base", "blh_base"))) + " FROM locations")(
    lambda s, d: _V.locations(s, d).select("station_id", zone_baseline().alias("z")).select("station_id", "z.*"))
query("feature_defaults", "SELECT grid_id, round(coalesce(aod_550, 0.6e0), 6) AS aod_550, round(coalesce(t2m_celsius, 25e0), 6) AS t2m_celsius, round(coalesce(wind_speed_10m, 4e0), 6) AS wind_speed_10m, round(coalesce(r2m, 65e0), 6) AS r2m, 800e0 AS blh FROM fused")(
    lambda s, d: _rounded(forecast.fill_defaults(_V.fused(s, d)).select("grid_id", "aod_550", "t2m_celsius", "wind_speed_10m", "r2m", "blh"), "aod_550", "t2m_celsius", "wind_speed_10m", "r2m"))
query("residuals", f"SELECT l_orderkey, l_linenumber, round(pm2_5 - ({_clamped(_LINEAR, 5, 500)}), 6) AS error, round(abs(pm2_5 - ({_clamped(_LINEAR, 5, 500)})), 6) AS abs_error FROM regr")(
    lambda s, d: _rounded(stats.residuals(_predicted(s, d), "pm2_5", "predicted").select("l_orderkey", "l_linenumber", "error", "abs_error"), "error", "abs_error"))
query("coord_label", "SELECT station_id, printf('%.2f°N, %.2f°E', latitude, longitude) AS label FROM locations")(
    lambda s, d: _V.locations(s, d).select("station_id", coord_label().alias("label")))
query("pollution_alerts", "SELECT event_id, strftime(datetime, '%Y-%m-%d') AS day, pm2_5 > 120 AS alert FROM readings")(
    lambda s, d: _V.readings(s, d).select("event_id", iso_date("datetime").alias("day"), pollution_alert("pm2_5").alias("alert")))
query("formula_pm25", f"SELECT l_orderkey, l_linenumber, l_partkey, round({_clamped(_LINEAR, 5, 500)}, 6) AS a, round({_clamped(_SEASONAL, 5, 250)}, 6) AS b FROM regr")(
    lambda s, d: _V.regr(s, d).select("l_orderkey", "l_linenumber", "l_partkey", _r(formula_pm25("linear")).alias("a"), _r(formula_pm25("seasonal")).alias("b")))
query("fallback_pm25", f"SELECT grid_id, round(coalesce(pm2_5, {_clamped('aod_550 * 120', 5, 500)}), 6) AS pm FROM fused")(
    lambda s, d: _V.fused(s, d).select("grid_id", _r(fallback_pm25("pm2_5", "aod_550")).alias("pm")))

# --- D: joins ---------------------------------------------------------------------

_SQL_ALIGNED = "SELECT *, date_trunc('hour', datetime + INTERVAL 30 MINUTE) AS hour FROM cells"


@query("fuse_sources", f""", aligned AS ({_SQL_ALIGNED}),
weather AS (SELECT cell_lat, cell_lon, hour, avg(CASE WHEN kind = 'signup' THEN pm2_5 % 45 END) AS t2m_celsius, avg(CASE WHEN kind = 'click' THEN pm2_5 % 12 END) AS wind_speed_10m FROM aligned WHERE kind IN ('signup', 'click', 'error') GROUP BY ALL),
aod AS (SELECT cell_lat, cell_lon, hour, avg(pm2_5 / 500) AS aod_550 FROM aligned WHERE kind = 'view' GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon, hour ORDER BY power(abs(latitude - cell_lat * 0.5e0), 2) + power(abs(longitude - cell_lon * 0.5e0), 2), station_id, pm2_5) AS rn
  FROM aligned WHERE kind = 'purchase' AND abs(latitude - cell_lat * 0.5e0) < 0.15e0 AND abs(longitude - cell_lon * 0.5e0) < 0.15e0)
SELECT w.cell_lat, w.cell_lon, strftime(w.hour, {_FMT}) AS hour, round(t2m_celsius, 6) AS t2m_celsius, round(aod_550, 6) AS aod_550, n.pm2_5, n.pm2_5 IS NOT NULL AS has_ground_truth
FROM weather w LEFT JOIN aod USING (cell_lat, cell_lon, hour) LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING (cell_lat, cell_lon, hour)""")
def _fuse(s, d):
    rows = fusion.aligned(_V.readings(s, d), 0.5)
    on = [*fusion.CELL, "datetime"]
    v, kind = F.col("pm2_5"), F.col("kind")
    weather = rows.where(kind.isin("signup", "click", "error")).groupBy(*on).agg(
        F.avg(F.when(kind == "signup", v % 45)).alias("t2m_celsius"), F.avg(F.when(kind == "click", v % 12)).alias("wind_speed_10m"))
    aod = rows.where(kind == "view").groupBy(*on).agg(F.avg(v / 500).alias("aod_550"))
    ground = fusion.match_stations(rows.where(kind == "purchase").select("datetime", "station_id", "pm2_5", "latitude", "longitude"),
                                   0.5, 0.15, by=["datetime"]).select(*on, "pm2_5")
    return fusion.fuse(weather, aod, ground).select(
        *fusion.CELL, _stamp("datetime").alias("hour"), _r("t2m_celsius").alias("t2m_celsius"), _r("aod_550").alias("aod_550"),
        "pm2_5", "has_ground_truth")


@query("station_match", """SELECT cell_lat, cell_lon, station_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_lat, cell_lon ORDER BY power(abs(latitude - cell_lat * 0.5e0), 2) + power(abs(longitude - cell_lon * 0.5e0), 2), station_id) AS rn
  FROM (SELECT DISTINCT station_id, latitude, longitude, cell_lat, cell_lon FROM cells)
  WHERE abs(latitude - cell_lat * 0.5e0) < 0.15e0 AND abs(longitude - cell_lon * 0.5e0) < 0.15e0) WHERE rn = 1""")
def _station_match(s, d):
    return fusion.match_stations(_V.locations(s, d), 0.5, 0.15).select(*fusion.CELL, "station_id")


@query("city_lookup", "SELECT station_id, name AS city, clat AS city_lat, clon AS city_lon, CAST(pop AS DOUBLE) AS population_m FROM locations LEFT JOIN city ON station_id % 2 = 0 AND i = (station_id // 2) % 10")
def _city_lookup(s, d):
    names = F.array(*[F.lit(c[0]) for c in fixed.CITIES])
    named = _V.locations(s, d).withColumn("city", F.when(
        F.col("station_id") % 2 == 0, F.element_at(names, (F.floor(F.col("station_id") / 2) % 10 + 1).cast("int"))))
    return fusion.city_lookup(named, "city").select("station_id", "city", "city_lat", "city_lon", F.col("population_m").cast("double").alias("population_m"))


_BOXES = [(n, a, b, c, e, i) for i, (n, a, b, c, e) in enumerate(fixed.REGION_BOXES)] + [
    ("south", 8.0, 20.0, 70.0, 85.0, 50), ("wide", 10.0, 30.0, 72.0, 90.0, 60)]


@query("box_join", ", boxes(name, a, b, c, e, priority) AS (VALUES " + ", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {e}e0, {p})" for n, a, b, c, e, p in _BOXES)
       + ") SELECT station_id, arg_min(name, priority) AS box, CAST(min(priority) AS DOUBLE) AS priority FROM locations LEFT JOIN boxes ON latitude BETWEEN a AND b AND longitude BETWEEN c AND e GROUP BY station_id")
def _box_join(s, d):
    boxes = fusion.literal_table(s, ["name", "lat_min", "lat_max", "lon_min", "lon_max", "priority"], _BOXES)
    return fusion.box_join(_V.locations(s, d), boxes, 0.5).select("station_id", "box", F.col("priority").cast("double").alias("priority"))


def _start() -> Column:
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


_DAYS = ", days AS (SELECT *, TIMESTAMP '2024-06-01 12:00:00' + CAST(n AS INT) * INTERVAL 1 DAY AS datetime FROM locations, range(5) t(n))"

query("forecast_calendar", _DAYS + f" SELECT station_id, CAST(n AS INT) AS day_number, strftime(datetime, {_FMT}) AS datetime FROM days")(
    lambda s, d: forecast.expand_days(_V.locations(s, d), _start(), 5).select("station_id", "day_number", _stamp("datetime").alias("datetime")))

# --- E: statistics ----------------------------------------------------------------

_STATS = "round(avg(pm2_5), 6) AS mean, round(median(pm2_5), 6) AS median, round(stddev_samp(pm2_5), 6) AS std, min(pm2_5) AS min, max(pm2_5) AS max, count(pm2_5) AS count"
query("summary_stats", f"SELECT {_STATS} FROM readings")(
    lambda s, d: _rounded(stats.summary_stats(_V.readings(s, d), "pm2_5"), "mean", "median", "std"))
query("summary_by_kind", f"SELECT kind, {_STATS} FROM readings GROUP BY kind")(
    lambda s, d: _rounded(stats.summary_stats(_V.readings(s, d), "pm2_5", ["kind"]), "mean", "median", "std"))
query("category_counts", f"SELECT {_sql_cpcb('pm2_5')} AS category, count(*) AS count FROM readings GROUP BY 1")(
    lambda s, d: stats.category_counts(_V.readings(s, d).select(cpcb_category("pm2_5").alias("category")), "category"))
query("health_shares", f"SELECT round(count_if({_sql_cpcb('pm2_5')} = 'Good') * 100.0 / count(*), 6)::DOUBLE AS good_pct, round(count_if(pm2_5 > 55.4e0) * 100.0 / count(*), 6)::DOUBLE AS unhealthy_pct FROM readings")(
    lambda s, d: _rounded(stats.shares(_V.readings(s, d), {"good_pct": cpcb_category("pm2_5") == "Good", "unhealthy_pct": F.col("pm2_5") > fixed.UNHEALTHY_ABOVE}), "good_pct", "unhealthy_pct"))
query("dominant_category", f"SELECT station_id, category, rows FROM (SELECT station_id, {_sql_cpcb('pm2_5')} AS category, count(*) AS rows, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, {_sql_cpcb('pm2_5')}) AS rn FROM readings GROUP BY ALL) WHERE rn = 1".replace("GROUP BY ALL", "GROUP BY 1, 2"))(
    lambda s, d: stats.dominant(_V.readings(s, d).select("station_id", cpcb_category("pm2_5").alias("category")), "category", ["station_id"]))


@query("regional_summary", f""", land AS (SELECT {_SQL_REGION} AS region, {_sql_cpcb('pm2_5')} AS category, pm2_5 FROM readings WHERE {_SQL_BOUNDS} AND {_SQL_LAND}),
best AS (SELECT region, category FROM (SELECT region, category, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, category) AS rn FROM land GROUP BY 1, 2) WHERE rn = 1),
agg AS (SELECT region, avg(pm2_5) AS m, min(pm2_5) AS lo, max(pm2_5) AS hi, stddev_samp(pm2_5) AS sd, count(*) AS n FROM land GROUP BY 1)
SELECT region, round(m, 6) AS mean_pm, lo AS min_pm, hi AS max_pm, round(sd, 6) AS std_pm, n AS count, category AS dominant_category,
  round({_sql_aqi('m')}, 6) AS aqi, {_sql_cpcb('m')} AS mean_category, {_sql_ladder('m', 'regional')} AS advisory_level FROM agg JOIN best USING (region)""")
def regional_summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.regional_summary(_V.readings(s, d)), "mean_pm", "std_pm", "aqi")


query("distinct_coverage", "SELECT count(*) AS records, count(DISTINCT grid_id) AS cells, count(DISTINCT datetime) AS times, count(DISTINCT CASE WHEN has_ground_truth THEN grid_id END) AS truth_cells FROM truth")(
    lambda s, d: stats.coverage(_V.fused(s, d), {"cells": F.col("grid_id"), "times": F.col("datetime"), "truth_cells": F.when(F.col("has_ground_truth"), F.col("grid_id"))}))
_NUM = ["pm2_5", "aod_550", "t2m_celsius", "wind_speed_10m", "r2m", "latitude"]
query("describe_numeric", " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM fused" for c in _NUM))(
    lambda s, d: _rounded(stats.describe_numeric(_V.fused(s, d).select(*_NUM)), "mean", "std", "min", "max", "q25", "q50", "q75"))
query("missing_profile", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column, round((count(*) - count({c})) * 1e2 / count(*), 6) AS missing_pct FROM fused" for c in _FUSED_COLS) + ") WHERE missing_pct > 0")(
    lambda s, d: _rounded(stats.missing_profile(_fused(s, d)), "missing_pct"))


def _sql_groups() -> str:
    found = stats.variable_groups(_FUSED_COLS, fixed.QUALITY_GROUPS) | {"overall": _FUSED_COLS}
    return " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", {len(cols)} AS columns, round((" + " + ".join(f"count({c}) * 1e2 / count(*)" for c in cols) + f") / {len(cols)}, 6) AS completeness_pct FROM fused"
        for g, cols in found.items() if cols)


query("group_completeness", _sql_groups())(lambda s, d: _rounded(stats.group_completeness(_fused(s, d)), "completeness_pct"))
query("daily_counts", "SELECT strftime(datetime, '%Y-%m-%d') AS day, count(*) AS count FROM readings GROUP BY 1")(
    lambda s, d: _V.readings(s, d).groupBy(iso_date("datetime").alias("day")).agg(F.count("*").alias("count")))
query("temporal_mean", f"SELECT strftime(date_trunc('day', datetime), {_FMT}) AS day, round(avg(pm2_5), 6) AS mean, count(pm2_5) AS count FROM readings GROUP BY 1")(
    lambda s, d: _rounded(stats.mean_by(_V.readings(s, d).withColumn("day", F.date_format(F.date_trunc("day", "datetime"), "yyyy-MM-dd HH:mm:ss")), "pm2_5", ["day"]), "mean"))
query("spatial_mean", "SELECT latitude, longitude, round(avg(pm2_5), 6) AS mean, count(pm2_5) AS count FROM readings GROUP BY 1, 2")(
    lambda s, d: _rounded(stats.mean_by(_V.readings(s, d), "pm2_5", ["latitude", "longitude"]), "mean"))
query("extent", f"SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, strftime(min(datetime), {_FMT}) AS first, strftime(max(datetime), {_FMT}) AS last, CAST(floor((floor(epoch(max(datetime))) - floor(epoch(min(datetime)))) / 86400) AS BIGINT) AS days, round((floor(epoch(max(datetime))) - floor(epoch(min(datetime)))) / 3600e0, 6) AS hours FROM readings")(
    lambda s, d: _rounded(stats.extent(_V.readings(s, d)).withColumns({"first": _stamp("first"), "last": _stamp("last")}), "hours"))
query("truth_coverage", "SELECT count(*) AS records, count_if(has_ground_truth)::BIGINT AS truth_records, count(DISTINCT CASE WHEN has_ground_truth THEN grid_id END) AS truth_cells, round(count_if(has_ground_truth) * 1e2 / count(*), 6) AS truth_pct, round(min(pm2_5), 6) AS target_min, round(max(pm2_5), 6) AS target_max, round(avg(pm2_5), 6) AS target_mean FROM truth")(
    lambda s, d: _rounded(stats.truth_coverage(_V.fused(s, d)), "truth_pct", "target_min", "target_max", "target_mean"))
query("source_availability", "SELECT 'weather' AS source, 2 AS columns, count(coalesce(t2m_celsius, wind_speed_10m)) AS rows, count(coalesce(t2m_celsius, wind_speed_10m)) > 0 AS available FROM fused UNION ALL SELECT 'satellite_aod', 1, count(aod_550), count(aod_550) > 0 FROM fused UNION ALL SELECT 'ground', 1, count(pm2_5), count(pm2_5) > 0 FROM fused")(
    lambda s, d: stats.source_availability(_fused(s, d)))
query("histogram", ", lim AS (SELECT min(pm2_5) AS lo, (max(pm2_5) - min(pm2_5)) / 20 AS w FROM readings) SELECT kind, CAST(least(floor((pm2_5 - lo) / w), 19) AS INT) AS bin, count(*) AS count FROM readings, lim GROUP BY 1, 2")(
    lambda s, d: stats.histogram(_V.readings(s, d), "pm2_5", 20, ["kind"]))
query("box_stats", ", q AS (SELECT kind, count(pm2_5) AS n, quantile_cont(pm2_5, 0.25) AS q25, quantile_cont(pm2_5, 0.5) AS q50, quantile_cont(pm2_5, 0.75) AS q75 FROM readings GROUP BY 1), f AS (SELECT r.kind, pm2_5, n, q25, q50, q75, pm2_5 BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS ins FROM readings r JOIN q ON r.kind = q.kind) SELECT kind, n, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(CASE WHEN ins THEN pm2_5 END) AS whisker_low, max(CASE WHEN ins THEN pm2_5 END) AS whisker_high, count_if(NOT ins)::BIGINT AS outliers FROM f GROUP BY ALL")(
    lambda s, d: _rounded(stats.box_stats(_V.readings(s, d), "pm2_5", ["kind"]), "q25", "q50", "q75"))
query("severity_band_counts", "SELECT " + ", ".join(f"count_if({_sql_cpcb('pm2_5')} IN ({', '.join(repr(n) for n in names)}))::BIGINT AS {band}" for band, names in fixed.SEVERITY_BANDS.items()) + " FROM readings")(
    lambda s, d: stats.severity_bands(_V.readings(s, d).select(cpcb_category("pm2_5").alias("category")), "category"))
_METRICS = "round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n"
query("regression_metrics", f"SELECT month, {_METRICS} FROM (SELECT CAST(month AS INT) AS month, pm2_5 AS y, pm2_5 - ({_clamped(_LINEAR, 5, 500)}) AS e FROM regr) GROUP BY month")(
    lambda s, d: _rounded(stats.regression_metrics(_predicted(s, d), "pm2_5", "predicted", ["month"]), "mae", "rmse", "r2"))

# --- F, G: order and sets ----------------------------------------------------------

query("top_k", "SELECT event_id, pm2_5 FROM readings ORDER BY pm2_5 DESC, event_id LIMIT 10")(
    lambda s, d: ranking.top_k(_V.readings(s, d).select("event_id", "pm2_5"), "pm2_5", 10, ["event_id"]))
query("preview", "SELECT event_id, pm2_5 FROM readings ORDER BY event_id LIMIT 5")(
    lambda s, d: ranking.preview(_V.readings(s, d).select("event_id", "pm2_5"), 5, ["event_id"]))
query("sample_n", "SELECT event_id, pm2_5 FROM readings ORDER BY md5('42|' || event_id), event_id LIMIT 1000")(
    lambda s, d: ranking.sample_n(_V.readings(s, d).select("event_id", "pm2_5"), 1000, ["event_id"]))
_EXTRA = {"view": "k", "click": "k", "error": "station_id"}
query("union_snapshots", " UNION ALL ".join(
    f"SELECT event_id, pm2_5, {'CAST(k AS DOUBLE)' if _EXTRA.get(kind) == 'k' else 'NULL::DOUBLE'} AS k, {'station_id' if _EXTRA.get(kind) == 'station_id' else 'NULL::BIGINT'} AS station_id FROM readings WHERE kind = '{kind}'"
    for kind in _V.KIND_COLUMNS))(
    lambda s, d: readers.union_snapshots([_V.readings(s, d).where(F.col("kind") == kind).select(
        "event_id", "pm2_5", *([F.col(_EXTRA[kind]).cast("double" if _EXTRA[kind] == "k" else "long").alias(_EXTRA[kind])] if kind in _EXTRA else []))
        for kind in _V.KIND_COLUMNS]))

@query("coverage_sketches", """, m AS (SELECT strftime(datetime, '%Y-%m') AS month, grid_id, datetime FROM truth)
  SELECT month, count(*) AS records, count(DISTINCT grid_id) AS cells, true AS cells_close, true AS days_close FROM m GROUP BY month""")
def _coverage_sketches(s, d):
    """Distinct cells and days per month: from stored daily sketches, held against the exact counts."""
    rows = _V.fused(s, d)
    names = ["cells", "days"]
    daily = stored(sketches.distinct_sketches(
        rows, {"day": F.to_date("datetime")}, {"cells": F.col("grid_id"), "days": F.col("datetime")}), "sketches")
    month = F.date_format("day", "yyyy-MM").alias("month")
    merged = sketches.estimates(sketches.merge_sketches(daily, [month], names), names)
    exact = rows.groupBy(F.date_format("datetime", "yyyy-MM").alias("month")).agg(
        F.count_distinct("grid_id").alias("_cells"), F.count_distinct("datetime").alias("_days"))
    bound = 5 * sketches.SIGMA
    return merged.join(exact, "month").select(
        "month", "records", F.col("_cells").alias("cells"),
        *[(F.abs(F.col(n) - F.col(f"_{n}")) <= F.col(f"_{n}") * bound).alias(f"{n}_close") for n in names])


@query("sql_functions", f"""SELECT event_id, round({_sql_aqi('pm2_5')}, 6) AS aqi, {_sql_cpcb('pm2_5')} AS cpcb, {_sql_epa('pm2_5')} AS epa,
  {_sql_ladder('pm2_5', 'regional')} AS level FROM readings WHERE {_sql_aqi('pm2_5')} > 100""")
def _sql_functions(s, d):
    sql_functions.register(s)
    return s.sql("""SELECT event_id, round(cpcb_aqi(pm2_5), 6) AS aqi, cpcb_category(pm2_5) AS cpcb, epa_category(pm2_5) AS epa,
        advisory_level_regional(pm2_5) AS level FROM {readings} WHERE cpcb_aqi(pm2_5) > 100""", readings=_V.readings(s, d))


# --- H: features, models, forecasts ------------------------------------------------

query("impute_mean", "SELECT grid_id, round(coalesce(pm2_5, avg(pm2_5) OVER ()), 6) AS pm2_5, round(coalesce(r2m, avg(r2m) OVER ()), 6) AS r2m FROM fused")(
    lambda s, d: _rounded(checks.impute_mean(_V.fused(s, d), ["pm2_5", "r2m"]).select("grid_id", "pm2_5", "r2m"), "pm2_5", "r2m"))


_SPLIT = "CAST('0x' || md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey)[1:8] AS BIGINT) % 10000 < 7000"


@query("train_test_split", f"SELECT count_if({_SPLIT})::BIGINT AS rows, 'train' AS part FROM regr UNION ALL SELECT count_if(NOT ({_SPLIT}))::BIGINT, 'test' FROM regr")
def _split(s, d):
    train, test = models.hash_split(_V.regr(s, d), _V.SPLIT_KEY)
    return train.agg(F.count("*").alias("rows"), F.lit("train").alias("part")).unionByName(
        test.agg(F.count("*").alias("rows"), F.lit("test").alias("part")))


def _fit_and_predict(estimator_of):
    def run(s, d):
        train, test = models.hash_split(_V.regr(s, d), _V.SPLIT_KEY)
        model = models.train(train, _V.REGR_FEATURES, estimator_of("pm2_5"))
        return model.transform(test).select(*_V.REGR_KEY, "pm2_5", _r("prediction").alias("prediction"))
    return run


query("forest_predictions")(_fit_and_predict(models.forest))
query("boosted_predictions")(_fit_and_predict(models.boosted))


@query("tuning_results")
def _tuning(s, d):
    train, _ = models.hash_split(_V.regr(s, d), _V.SPLIT_KEY)
    rows = []
    for name, estimator, grid in (("forest", models.forest("pm2_5"), fixed.FOREST_GRID), ("boosted", models.boosted("pm2_5"), fixed.BOOSTED_GRID)):
        results = models.tune(models.random_splits(train, _V.SPLIT_KEY), _V.REGR_FEATURES, estimator, grid)
        rows += [(name, p.get("numTrees", p.get("maxIter")), p["maxDepth"], p.get("minInstancesPerNode", 1), p["featureSubsetStrategy"],
                  float(p.get("stepSize", 0)), float(p.get("subsamplingRate", 1)), float(m)) for p, m in results]
    return fusion.literal_table(s, ["model", "trees", "max_depth", "min_rows", "features", "rate", "row_share", "mae"], rows)


@query("feature_importance")
def _importance(s, d):
    train, _ = models.hash_split(_V.regr(s, d), _V.SPLIT_KEY)
    return models.feature_importance(train, models.train(train, _V.REGR_FEATURES, models.forest("pm2_5")), _V.REGR_FEATURES)


@query("score_model")
def _score_model(s, d):
    train, _ = models.hash_split(_V.regr(s, d), _V.SPLIT_KEY)
    path = models.save(models.train(train, _V.REGR_FEATURES, models.forest("pm2_5")), scratch_path(s, "model"))
    scored = forecast.score(forecast.fill_defaults(_V.fused(s, d)), models.predictor(models.load(path)))
    return scored.select("grid_id", _stamp("datetime").alias("datetime"), _r("pm2_5").alias("pm2_5"), "aqi", "category")


_ERRORS = "count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2"
_FORMULA = _clamped(_LINEAR, 5, 500)


@query("forward_validation", f""", dn AS (SELECT day, count(*) AS c FROM regr GROUP BY 1),
  f AS (SELECT day, CAST(floor(coalesce(sum(c) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 6 / (SELECT sum(c) FROM dn)) + 1 AS INT) AS fold FROM dn),
  p AS (SELECT fold, pm2_5 AS y, {_FORMULA} AS yhat FROM regr JOIN f USING (day)),
  b AS (SELECT k.i AS k, avg(y - yhat) AS bias, count(*) AS n_train FROM range(2, 7) k(i) JOIN p ON fold < k.i GROUP BY 1),
  x AS (SELECT k, n_train, y, y - yhat - bias AS e FROM p JOIN b ON fold = k)
  SELECT CAST(k - 1 AS INT) AS fold, n_train, {_ERRORS} FROM x GROUP BY k, n_train""")
def _forward_validation(s, d):
    splits = checks.forward_splits(_V.regr(s, d), "datetime", 6)
    return _rounded(models.validate(splits, models.corrected_formula("pm2_5"), "pm2_5"), "mae", "rmse", "r2")


_AROUND = " AND ".join(f"(floor((cell_lat + {i}) / 4e0) * 31 + floor((cell_lon + {j}) / 4e0)) % 5 + 1 <> k.i" for i in (-1, 0, 1) for j in (-1, 0, 1))


@query("station_validation", f""", q AS (SELECT cell_lat, cell_lon, pm2_5 AS y, coalesce(aod_550, 0.6e0) AS aod_550, coalesce(t2m_celsius, 25e0) AS t2m_celsius,
    coalesce(wind_speed_10m, 4e0) AS wind_speed_10m, coalesce(r2m, 65e0) AS r2m, 800e0 AS blh FROM fused WHERE pm2_5 IS NOT NULL),
  p AS (SELECT *, {_FORMULA} AS yhat, (floor(cell_lat / 4e0) * 31 + floor(cell_lon / 4e0)) % 5 + 1 AS own FROM q),
  b AS (SELECT k.i AS k, avg(y - yhat) AS bias, count(*) AS n_train FROM range(1, 6) k(i) JOIN p ON {_AROUND} GROUP BY 1),
  x AS (SELECT k, n_train, y, y - yhat - bias AS e FROM p JOIN b ON own = k)
  SELECT CAST(k AS INT) AS fold, n_train, {_ERRORS} FROM x GROUP BY k, n_train""")
def _station_validation(s, d):
    rows = forecast.fill_defaults(filters.require_target(_V.fused(s, d), "pm2_5"))
    splits = checks.station_splits(rows, "cell_lat", "cell_lon", 5, size=4, guard=1)
    return _rounded(models.validate(splits, models.corrected_formula("pm2_5"), "pm2_5"), "mae", "rmse", "r2")


query("score_batch", f", f AS (SELECT grid_id, datetime, coalesce(aod_550, 0.6e0) AS aod_550, coalesce(t2m_celsius, 25e0) AS t2m_celsius, coalesce(wind_speed_10m, 4e0) AS wind_speed_10m, coalesce(r2m, 65e0) AS r2m, 800e0 AS blh FROM fused), p AS (SELECT *, {_clamped(_LINEAR, 5, 500)} AS pm FROM f) SELECT grid_id, strftime(datetime, {_FMT}) AS datetime, round(pm, 6) AS pm2_5, CAST(trunc({_sql_aqi('pm')}) AS INT) AS aqi, {_sql_cpcb('pm')} AS category FROM p")(
    lambda s, d: forecast.score(forecast.fill_defaults(_V.fused(s, d))).select("grid_id", _stamp("datetime").alias("datetime"), _r("pm2_5").alias("pm2_5"), "aqi", "category"))


@query("model_comparison", ", m AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, {p} AS priority, {_METRICS} FROM (SELECT pm2_5 AS y, pm2_5 - ({_clamped(f, 5, h)}) AS e FROM regr)"
    for n, p, f, h in (("linear", 0, _LINEAR, 500), ("seasonal", 1, _SEASONAL, 250))) + ") SELECT model, mae, rmse, r2, n FROM m ORDER BY r2 DESC, priority LIMIT 1")
def _comparison(s, d):
    rows = _V.regr(s, d)
    both = [stats.regression_metrics(rows.withColumn("predicted", formula_pm25(v)), "pm2_5", "predicted").select(
        F.lit(v).alias("model"), F.lit(p).alias("priority"), "mae", "rmse", "r2", "n") for p, v in enumerate(("linear", "seasonal"))]
    return _rounded(ranking.choose_best(both[0].unionByName(both[1]), "r2", F.col("priority")).drop("priority"), "mae", "rmse", "r2")


_TEMPS = "CASE season " + " ".join(f"WHEN {i} THEN {t}e0" for i, (t, _) in enumerate(fixed.SEASON_BASE, 1)) + " END"
_HUMID = "CASE season " + " ".join(f"WHEN {i} THEN {h}e0" for i, (_, h) in enumerate(fixed.SEASON_BASE, 1)) + " END"
_FEATURES = _DAYS + f", feat AS (SELECT *, {_sql_season('month(datetime)', 'monsoon')} AS season, {_sql_zone_value(1)} AS aod0, {_sql_zone_value(2)} AS wind_speed_10m, {_sql_zone_value(3)} AS blh FROM days), fx AS (SELECT *, {_TEMPS} AS t2m_celsius, {_HUMID} AS r2m FROM feat)"
query("baseline_features", _FEATURES + f" SELECT station_id, strftime(datetime, {_FMT}) AS datetime, season, aod0 AS aod_550, wind_speed_10m, blh, t2m_celsius, r2m FROM fx")(
    lambda s, d: forecast.baseline_features(forecast.expand_days(_V.locations(s, d), _start(), 5)).select("station_id", _stamp("datetime").alias("datetime"), "season", "aod_550", "wind_speed_10m", "blh", "t2m_celsius", "r2m"))
_DAILY = _FEATURES + f", ramp AS (SELECT *, least(2e0, aod0 + least(0.3e0, n * 0.1e0)) AS aod_550 FROM fx), daily AS (SELECT station_id, datetime, {_clamped(_LINEAR, 5, 500)} AS pm FROM ramp), fd AS (SELECT *, CAST(trunc({_sql_aqi('pm')}) AS INT) AS aqi FROM daily)"
query("forecast_daily", _DAILY + f" SELECT station_id, strftime(datetime, {_FMT}) AS datetime, round(pm, 6) AS pm2_5, aqi, {_sql_cpcb('pm')} AS category FROM fd")(
    lambda s, d: forecast.forecast(_V.locations(s, d), _start(), 5).select("station_id", _stamp("datetime").alias("datetime"), _r("pm2_5").alias("pm2_5"), "aqi", "category"))
query("forecast_summary", _DAILY + f" SELECT station_id, round(avg(pm), 6) AS mean_pm, round(max(pm), 6) AS peak_pm, round(avg(aqi), 6) AS mean_aqi, strftime(arg_min(datetime, (-pm, datetime)), '%Y-%m-%d') AS worst_day, {_sql_ladder('avg(pm)', 'forecast')} AS advisory_level, max(pm) > 120 AS alert FROM fd GROUP BY 1")(
    lambda s, d: _rounded(forecast.forecast_summary(forecast.forecast(_V.locations(s, d), _start(), 5), "station_id").withColumn("worst_day", F.date_format("worst_day", "yyyy-MM-dd")), "mean_pm", "peak_pm", "mean_aqi"))
query("worst_day", f"SELECT station_id, strftime(datetime, {_FMT}) AS datetime, pm2_5 FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY pm2_5 DESC, datetime) AS rn FROM readings) WHERE rn = 1")(
    lambda s, d: ranking.worst_row(_V.readings(s, d).select("station_id", "datetime", "pm2_5"), "pm2_5", "datetime", ["station_id"]).withColumn("datetime", _stamp("datetime")).select("station_id", "datetime", "pm2_5"))
query("city_status", _FEATURES + f", c AS (SELECT *, aod0 AS aod_550 FROM fx WHERE n = 0), p AS (SELECT *, {_clamped(_LINEAR, 5, 500)} AS pm FROM c), s AS (SELECT city.name AS city, avg(pm) AS pm FROM p JOIN city ON station_id % 2 = 0 AND i = (station_id // 2) % 10 GROUP BY 1) SELECT city, round(pm, 6) AS pm2_5, CAST(trunc({_sql_aqi('pm')}) AS INT) AS aqi, {_sql_cpcb('pm')} AS category FROM s")(
    lambda s, d: forecast.forecast(_V.locations(s, d).where("station_id % 2 = 0"), _start(), 1).groupBy(
        F.element_at(F.array(*[F.lit(c[0]) for c in fixed.CITIES]), (F.floor(F.col("station_id") / 2) % 10 + 1).cast("int")).alias("city")
    ).agg(F.avg("pm2_5").alias("pm")).select("city", _r("pm").alias("pm2_5"), cpcb_aqi("pm").cast("int").alias("aqi"), cpcb_category("pm").alias("category")))


@query("grid_coverage", ", g AS (SELECT DISTINCT cell_lat, cell_lon FROM cells WHERE cell_lon BETWEEN 136 AND 194) SELECT CAST(r.i AS INT) AS cell_lat, CAST(59 AS BIGINT) AS expected, count(cell_lon) AS found, round(count(cell_lon) * 1e2 / 59, 6) AS coverage_pct FROM range(16, 75) r(i) LEFT JOIN g ON cell_lat = r.i GROUP BY r.i")
def _grid_coverage(s, d):
    return _rounded(fusion.grid_coverage(fusion.snap(_V.readings(s, d), 0.5), fixed.NATIONAL_BOUNDS, 0.5), "coverage_pct")


_CELL_STEPS = """, m AS (SELECT cell_lat, cell_lon, CAST(datetime AS DATE) AS day, CAST(floor(hour(datetime) / 3e0) AS INT) AS step FROM cells
  WHERE cell_lat BETWEEN 16 AND 74 AND cell_lon BETWEEN 136 AND 194 GROUP BY ALL)"""
query("step_coverage", _CELL_STEPS + f" SELECT strftime(day, '%Y-%m-%d') AS day, CAST({59 * 59 * 8} AS BIGINT) AS expected, count(*) AS found, count(DISTINCT (cell_lat, cell_lon)) AS cells, round(count(*) * 1e2 / {59 * 59 * 8}, 6) AS coverage_pct FROM m GROUP BY m.day")(
    lambda s, d: _rounded(fusion.step_coverage(_V.readings(s, d), fixed.NATIONAL_BOUNDS, 0.5).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "coverage_pct"))
query("step_gaps", _CELL_STEPS + """, c AS (SELECT DISTINCT cell_lat, cell_lon, day FROM m), g AS (SELECT c.*, k.i AS step FROM c JOIN range(0, 8) k(i) ON true ANTI JOIN m ON m.cell_lat = c.cell_lat AND m.cell_lon = c.cell_lon AND m.day = c.day AND m.step = k.i)
  SELECT cell_lat, cell_lon, strftime(day, '%Y-%m-%d') AS day, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS missing FROM g GROUP BY cell_lat, cell_lon, g.day""")(
    lambda s, d: fusion.step_gaps(_V.readings(s, d), fixed.NATIONAL_BOUNDS, 0.5).select("cell_lat", "cell_lon", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join(F.transform("missing", lambda k: k.cast("string")), ",").alias("missing")))


@query("fuse_nearest", f""", w AS (SELECT event_id, cell_lat, cell_lon, datetime, pm2_5 % 45 AS t2m_celsius FROM cells WHERE kind = 'signup'),
  g AS (SELECT cell_lat, cell_lon, datetime AS tm, min(pm2_5) AS pm FROM cells WHERE kind = 'purchase' GROUP BY 1, 2, 3),
  n AS (SELECT event_id, tm, pm, abs(epoch_us(tm) - epoch_us(datetime)) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(tm) - epoch_us(datetime)), tm) AS rn
    FROM w JOIN g ON w.cell_lat = g.cell_lat AND w.cell_lon = g.cell_lon AND abs(epoch_us(tm) - epoch_us(datetime)) <= 43200000000)
  SELECT w.event_id, t2m_celsius, pm AS matched_pm2_5, strftime(tm, {_FMT}) AS matched_datetime, round(gap / 1e6, 6) AS gap_seconds FROM w LEFT JOIN n ON w.event_id = n.event_id AND rn = 1""")
def _fuse_nearest(s, d):
    cells = fusion.snap(_V.readings(s, d), 0.5)
    weather = cells.where("kind = 'signup'").select("event_id", *fusion.CELL, "datetime", (F.col("pm2_5") % 45).alias("t2m_celsius"))
    ground = cells.where("kind = 'purchase'").select(*fusion.CELL, "datetime", "pm2_5")
    out = fusion.fuse_nearest(weather, ground, fusion.CELL, "datetime", 12 * 3600)
    return _rounded(out.select("event_id", "t2m_celsius", "matched_pm2_5", _stamp("matched_datetime").alias("matched_datetime"), "gap_seconds"), "gap_seconds")


# --- X: checks --------------------------------------------------------------------

query("outlier_flags", ", q AS (SELECT station_id, quantile_cont(pm2_5, 0.25) AS a, quantile_cont(pm2_5, 0.75) AS b FROM readings GROUP BY 1) SELECT event_id, pm2_5 < 0 AS negative, NOT (pm2_5 BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a)) AS outlier FROM readings JOIN q USING (station_id)")(
    lambda s, d: checks.outlier_flags(_V.readings(s, d).select("event_id", "station_id", "pm2_5"), "pm2_5", ["station_id"]).select("event_id", "negative", "outlier"))
query("temporal_checks", ", w AS (SELECT *, lag(datetime) OVER o AS t0, lag(pm2_5) OVER o AS v0 FROM readings WINDOW o AS (PARTITION BY station_id ORDER BY datetime, pm2_5)) SELECT event_id, round((epoch(datetime) - epoch(t0)) / 3600, 6) AS gap_hours, coalesce(datetime = t0, false) AS duplicate, coalesce((epoch(datetime) - epoch(t0)) / 3600 > 3, false) AS gap, coalesce(abs(pm2_5 - v0) > 100, false) AS spike FROM w")(
    lambda s, d: _rounded(checks.temporal_checks(_V.readings(s, d).select("event_id", "station_id", "datetime", "pm2_5"), "station_id", "datetime", "pm2_5", 3.0, 100.0).select("event_id", "gap_hours", "duplicate", "gap", "spike"), "gap_hours"))
query("temporal_folds", ", dn AS (SELECT CAST(datetime AS DATE) AS day, count(*) AS n FROM readings GROUP BY 1), f AS (SELECT day, CAST(floor(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5 / (SELECT sum(n) FROM dn)) + 1 AS INT) AS fold FROM dn) SELECT event_id, fold FROM readings JOIN f ON CAST(datetime AS DATE) = day")(
    lambda s, d: checks.temporal_folds(_V.readings(s, d), "datetime", 5).select("event_id", "fold"))
query("spatial_folds", "SELECT event_id, CAST((cell_lat * 31 + cell_lon) % 5 + 1 AS INT) AS fold FROM cells")(
    lambda s, d: _V.readings(s, d).select("event_id", checks.spatial_folds(cell_index("latitude", 0.5), cell_index("longitude", 0.5), 5).alias("fold")))
query("standardize", "SELECT event_id, round((pm2_5 - avg(pm2_5) OVER ()) / stddev_samp(pm2_5) OVER (), 6) AS pm2_5_z FROM readings")(
    lambda s, d: _rounded(checks.standardize(_V.readings(s, d).select("event_id", "pm2_5"), ["pm2_5"]).select("event_id", "pm2_5_z"), "pm2_5_z"))
query("forecast_interval", f", p AS (SELECT *, {_clamped(_LINEAR, 5, 500)} AS yhat FROM regr), c AS (SELECT *, {_sql_cpcb('yhat')} AS category FROM p), q AS (SELECT category, quantile_cont(pm2_5 - yhat, 0.05) AS a, quantile_cont(pm2_5 - yhat, 0.95) AS b FROM c GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(yhat + a, 6) AS lower, round(yhat + b, 6) AS upper FROM c JOIN q USING (category)")(
    lambda s, d: _rounded(checks.forecast_interval(_predicted(s, d).withColumn("category", cpcb_category("predicted")), "pm2_5", "predicted", ["category"]).select("l_orderkey", "l_linenumber", "l_partkey", "lower", "upper"), "lower", "upper"))
query("daily_trend", ", dm AS (SELECT kind, CAST(datetime AS DATE) AS day, avg(pm2_5) AS mean FROM readings GROUP BY 1, 2) SELECT kind, strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, round(avg(mean) OVER w, 6) AS trend, round(regr_slope(mean, date_diff('day', DATE '1970-01-01', day)) OVER w, 6) AS slope FROM dm WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")(
    lambda s, d: _rounded(checks.daily_trend(_V.readings(s, d), "datetime", "pm2_5", ["kind"]).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "mean", "trend", "slope"))

# --- S: streams -------------------------------------------------------------------

#: every so many readings of the first quarter arrives with the last file
_LATE = 97


def _quarter(s: SparkSession, d: str):
    """Quarter (0..3) of the time that the events span."""
    events = _V.table(s, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at)).scalar(), events.agg(F.max(at)).scalar()
    return F.least(F.lit(3), F.expr("_at - _first") * 4 / F.greatest(F.lit(1), F.expr("_last - _first"))).cast("int"), at, first, last


def _landed(s: SparkSession, d: str) -> str:
    """Four files of events in time order, some rows of the first only in the last."""
    quarter, at, first, last = _quarter(s, d)
    rows = _V.table(s, d, "events").withColumns({"_at": at, "_first": first, "_last": last})
    late = (quarter == 0) & (F.col("event_id") % _LATE == 0)
    dealt = stored(rows.withColumn("_file", F.when(late, 3).otherwise(quarter)).drop("_at", "_first", "_last"), "events")
    folder = scratch_path(s, "landing")
    for k in range(4):
        # the stream takes the files in the order of their times
        dealt.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return folder


def _events_stream(s: SparkSession, d: str) -> DataFrame:
    lat, lon = _V._station_position(F.col("user_id"))
    return streams.read_stream(s, _landed(s, d), _V.table(s, d, "events").schema, files_per_batch=1).select(
        "event_id", F.col("ts").cast("timestamp").alias("datetime"), F.col("user_id").alias("station_id"),
        F.col("value").alias("pm2_5"), cell_index(lat, 0.5).alias("cell_lat"), cell_index(lon, 0.5).alias("cell_lon"))


@query("stream_windowed_aqi", f""", lim AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM readings),
  files AS (SELECT c.*, CASE WHEN q = 0 AND event_id % {_LATE} = 0 THEN 3 ELSE q END AS file, q = 0 AND event_id % {_LATE} = 0 AS held FROM (
    SELECT cells.*, least(3, CAST(floor((epoch_us(datetime) - epoch_us(lo)) * 4 / greatest(1, epoch_us(hi) - epoch_us(lo))) AS INT)) AS q FROM cells, lim) c),
  mark AS (SELECT max(datetime) - INTERVAL 1 HOUR AS tm FROM files WHERE file < 3),
  w AS (SELECT time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01') AS ws, cell_lat, cell_lon, avg(pm2_5) AS m, count(*) AS n FROM files, mark
    WHERE NOT (held AND time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= tm) GROUP BY 1, 2, 3)
SELECT strftime(ws, {_FMT}) AS window_start, cell_lat, cell_lon, round(m, 6) AS mean_pm, n AS count, {_sql_cpcb('m')} AS category FROM w WHERE ws + INTERVAL 6 HOUR <= (SELECT max(datetime) - INTERVAL 1 HOUR FROM readings)""")
def _stream_windowed(s, d):
    out = streams.run_available(streams.windowed_aqi(_events_stream(s, d)))
    return out.select(_stamp("window_start").alias("window_start"), "cell_lat", "cell_lon", _r("mean_pm").alias("mean_pm"), "count", "category")


@query("stream_latest", f"SELECT station_id, strftime(datetime, {_FMT}) AS datetime, pm2_5 FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY datetime DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1")
def _stream_latest(s, d):
    out = streams.upsert_latest(_events_stream(s, d).drop("cell_lat", "cell_lon"), ["station_id"], "datetime")
    return out.select("station_id", _stamp("datetime").alias("datetime"), "pm2_5")
