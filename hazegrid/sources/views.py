"""Air-quality views on the given tables.

Every view is a lazy plan; columns that a query does not use are never read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell_index, fixed, formula_pm25, grid_id
from ..session import prepare
from .readers import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(prepare(spark), os.path.join(folder, f"{name}.parquet"))


def _station_position(station: Column) -> tuple[Column, Column]:
    """Coordinates of a station, a function of its number alone (no join)."""
    city = F.pmod(F.floor(station / 2), F.lit(10)).cast("int") + 1
    city_lat = F.element_at(F.array(*[F.lit(c[1]) for c in fixed.CITIES]), city)
    city_lon = F.element_at(F.array(*[F.lit(c[2]) for c in fixed.CITIES]), city)
    near_city = station % 2 == 0
    lat = F.when(near_city, city_lat + ((station % 7) - 3) / F.lit(20.0)).otherwise(
        F.lit(8) + ((station * 37) % 290) / F.lit(10.0))
    lon = F.when(near_city, city_lon + ((station % 5) - 2) / F.lit(20.0)).otherwise(
        F.lit(68) + ((station * 53) % 289) / F.lit(10.0))
    return lat, lon


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """Stations: one row per user of ``events``."""
    stations = table(spark, folder, "events").select(F.col("user_id").alias("station_id")).distinct()
    lat, lon = _station_position(F.col("station_id"))
    return stations.select("station_id", lat.alias("latitude"), lon.alias("longitude"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Station time series."""
    lat, lon = _station_position(F.col("user_id"))
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("datetime"),
        F.col("user_id").alias("station_id"),
        F.col("value").alias("pm2_5"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        lat.alias("latitude"),
        lon.alias("longitude"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Readings in the form of a prediction snapshot table."""
    return readings(spark, folder).select(
        "event_id", "datetime", "latitude", "longitude", F.col("pm2_5").alias("predicted_pm2_5")
    )


KIND_COLUMNS = {
    "purchase": ("pm2_5", lambda v: v),
    "view": ("aod_550", lambda v: v / 500),
    "signup": ("t2m_celsius", lambda v: v % 45),
    "click": ("wind_speed_10m", lambda v: v % 12),
    "error": ("r2m", lambda v: v % 100),
}


def fused(spark: SparkSession, folder: str, resolution: float = 0.5) -> DataFrame:
    """Sparse wide table: one row per (cell, day), one column per kind of reading."""
    cells = readings(spark, folder).select(
        cell_index("latitude", resolution).alias("cell_lat"),
        cell_index("longitude", resolution).alias("cell_lon"),
        F.date_trunc("day", "datetime").alias("datetime"),
        "kind", "pm2_5",
    )
    value = F.col("pm2_5")
    wide = cells.groupBy("cell_lat", "cell_lon", "datetime").agg(*[
        F.avg(F.when(F.col("kind") == kind, make(value))).alias(name)
        for kind, (name, make) in KIND_COLUMNS.items()
    ])
    return wide.select(
        grid_id("cell_lat", "cell_lon", resolution).alias("grid_id"),
        "cell_lat", "cell_lon", "datetime",
        (F.col("cell_lat") * resolution).alias("latitude"),
        (F.col("cell_lon") * resolution).alias("longitude"),
        *[name for name, _ in KIND_COLUMNS.values()],
        F.col("pm2_5").isNotNull().alias("has_ground_truth"),
    )


def regr(spark: SparkSession, folder: str) -> DataFrame:
    """Large supervised table: order lines with part sizes."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    lines = table(spark, folder, "lineitem")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_shipdate").cast("timestamp").alias("datetime"),
        (F.col("l_discount") * 8).alias("aod_550"),
        (F.col("l_quantity") % 45).alias("t2m_celsius"),
        (F.lit(1) + F.col("l_tax") * 100).alias("wind_speed_10m"),
        (F.lit(30) + F.col("p_size")).cast("double").alias("r2m"),
        (F.lit(300) + F.col("l_quantity") * 10).alias("blh"),
        F.month("l_shipdate").alias("month"),
    )
    return rows.withColumn("pm2_5", formula_pm25("linear", limit=False) + F.col("l_extendedprice") % 10)


REGR_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: whole numbers, which read alike as text everywhere
SPLIT_KEY = REGR_KEY[:4]
REGR_FEATURES = ["aod_550", "t2m_celsius", "wind_speed_10m", "r2m", "blh"]
