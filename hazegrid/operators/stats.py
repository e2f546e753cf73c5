"""Summaries: every function is one aggregation with partial results on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import advisory_level, cpcb_aqi, cpcb_category, fixed, region_of
from .filters import exclude_zones, within_bounds
from .quantiles import exact_quantiles


def with_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put a result per group beside rows; NULL groups meet too.  Without groups it is one row, attached as scalars."""
    if not by:
        return left.withColumns({c: right.agg(F.max(c)).scalar() for c in right.columns})
    renamed = right.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)],
                           *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & left[b].eqNullSafe(renamed[f"_k{i}"])
    return left.join(renamed, same, "left").drop(*[f"_k{i}" for i in range(len(by))])


def steady_mean(column: str) -> Column:
    """Mean that does not hang on the order of the rows.

    Twelve decimal digits of a value add up exactly; only what a value has beyond
    them, and what is no such decimal (infinite, beyond 10^18), is summed as a double.
    """
    value = F.col(column)
    digits = F.when(value.isNotNull(), F.coalesce(value.try_cast("decimal(30,12)"), F.lit(0).cast("decimal(30,12)")))
    return (F.sum(digits).cast("double") + F.sum(value - digits.cast("double"))) / F.nullif(F.count(value), F.lit(0))


def summary_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, sample standard deviation, minimum, maximum and count."""
    basic = df.groupBy(*by).agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        F.max(column).alias("max"), F.count(column).alias("count"))
    median = exact_quantiles(df, column, {"median": 0.5}, by).drop("n")
    return with_keys(basic, median, by)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, most frequent first; ties by name."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def shares(df: DataFrame, tests: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows that pass each test."""
    return df.groupBy(*by).agg(*[
        (F.count_if(test) * 100.0 / F.count("*")).alias(name) for name, test in tests.items()])


def dominant(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per group, the smallest of equally frequent ones.

    Counts per (group, value) come first, so a large group is counted on the map side.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    least = F.min(F.struct((-F.col("_n")).alias("_m"), F.col(column).alias("_v")))
    return counted.groupBy(*by).agg(least.alias("_best")).select(
        *by, F.col("_best._v").alias(column), (-F.col("_best._m")).alias("rows"))


def regional_summary(df: DataFrame, pm: str = "pm2_5") -> DataFrame:
    """Roll-up per region of the mainland rows, worst air first.

    Mean, minimum, maximum, sample deviation and count of PM2.5, the most
    frequent category, index and category of the mean, and the advisory level.
    Rows are folded to counts per (region, category) first; both results come
    from that one shuffle of few rows.
    """
    rows = exclude_zones(within_bounds(df)).where(F.col(pm).isNotNull()).select(
        region_of().alias("region"), cpcb_category(pm).alias("category"), F.col(pm).alias("_pm"))
    folded = rows.groupBy("region", "category").agg(
        F.count("*").alias("_n"), F.sum("_pm").alias("_s"), F.sum(F.col("_pm") * F.col("_pm")).alias("_ss"),
        F.min("_pm").alias("_low"), F.max("_pm").alias("_high"))
    n, s = F.sum("_n"), F.sum("_s")
    best = F.min(F.struct((-F.col("_n")).alias("_m"), "category"))
    out = folded.groupBy("region").agg(
        (s / n).alias("mean_pm"), F.min("_low").alias("min_pm"), F.max("_high").alias("max_pm"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.sum("_ss") - s * s / n) / (n - 1))).alias("std_pm"),
        n.alias("count"), best.alias("_best"))
    return out.select(
        "region", "mean_pm", "min_pm", "max_pm", "std_pm", "count", F.col("_best.category").alias("dominant_category"),
        cpcb_aqi("mean_pm").alias("aqi"), cpcb_category("mean_pm").alias("mean_category"),
        advisory_level("mean_pm").alias("advisory_level")).orderBy(F.desc("mean_pm"), "region")


def coverage(df: DataFrame, names: Mapping[str, Column], approximate: bool = False) -> DataFrame:
    """Distinct values of each expression; the approximate count only on request."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("records"), *[count(c).alias(name) for name, c in names.items()])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One line per numeric column: count, mean, std, min, quartiles, max."""
    names = list(columns or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"]).drop("n")
    return with_keys(basic, quartiles, ["column"])


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing percentage of every column that has missing values, largest first."""
    names = list(columns or df.columns)
    one = df.agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*")).alias(c) for c in names])
    return one.unpivot([], names, "column", "missing_pct").where("missing_pct > 0").orderBy(
        F.desc("missing_pct"), "column")


def variable_groups(names: Sequence[str], groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Columns of each group: those whose name contains one of its parts, in any case."""
    return {g: [n for n in names if any(p in n.lower() for p in parts)] for g, parts in groups.items()}


def group_completeness(df: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Mean completeness in percent of each group's columns, and of all columns as ``overall``."""
    found = variable_groups(df.columns, groups or fixed.QUALITY_GROUPS)
    found["overall"] = list(df.columns)
    one = df.agg(*[(F.count(c) * 100.0 / F.count("*")).alias(c) for c in df.columns])
    parts = [
        F.struct(F.lit(g).alias("group"), F.lit(len(cols)).alias("columns"),
                 (sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)).alias("completeness_pct"))
        for g, cols in found.items() if cols]
    return one.select(F.inline(F.array(*parts)))


def mean_by(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.count(column).alias("count"))


def extent(df: DataFrame, ts: str = "datetime", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Smallest and largest position and time, and the time between in days and hours."""
    seconds = F.max(ts).cast("timestamp").cast("long") - F.min(ts).cast("timestamp").cast("long")
    return df.agg(
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
        F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.floor(seconds / 86400).cast("long").alias("days"), (seconds / 3600).alias("hours"))


def truth_coverage(df: DataFrame, cell: str = "grid_id", target: str = "pm2_5") -> DataFrame:
    """Rows and cells with ground truth, their share, and the target's range."""
    flag = F.col("has_ground_truth")
    return df.agg(
        F.count("*").alias("records"), F.count_if(flag).alias("truth_records"),
        F.count_distinct(F.when(flag, F.col(cell))).alias("truth_cells"),
        (F.count_if(flag) * 100.0 / F.count("*")).alias("truth_pct"),
        F.min(target).alias("target_min"), F.max(target).alias("target_max"), F.avg(target).alias("target_mean"))


def source_availability(df: DataFrame, markers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per source: how many columns it has and how many rows hold a value in one of them."""
    found = variable_groups(df.columns, markers or fixed.SOURCE_MARKERS)
    counts = df.agg(*[
        F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull() if cols else F.lit(False)).alias(g)
        for g, cols in found.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("source"), F.lit(len(cols)).alias("columns"), F.col(g).alias("rows"),
                 (F.col(g) > 0).alias("available")) for g, cols in found.items()])))


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin between the column's smallest and largest value; the last bin is closed.

    The limits are scalar subqueries, so bins of different groups agree.
    """
    limits = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    width = (high - low) / bins
    number = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(*by, number.alias("bin")).agg(F.count("*").alias("count"))


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and outliers beyond."""
    quartiles = exact_quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    limits = quartiles.withColumns({"_low": F.col("q25") - reach, "_high": F.col("q75") + reach})
    rows = df.select(*by, F.col(column).alias("_v")).where("_v IS NOT NULL")
    joined = with_keys(rows, limits, by)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    return joined.groupBy(*by, "n", "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def severity_bands(df: DataFrame, category: str) -> DataFrame:
    """Rows in the bands good, moderate and poor of a CPCB category column."""
    return df.agg(*[F.count_if(F.col(category).isin(*names)).alias(band) for band, names in fixed.SEVERITY_BANDS.items()])


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and n over rows with both values; R2 is NULL where the actual values do not vary."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    rows = df.where(y.isNotNull() & F.col(predicted).isNotNull())
    total = F.var_pop(y) * F.count(y)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > 0, 1 - F.sum(error * error) / total).alias("r2"), F.count(y).alias("n"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.withColumns({"error": error, "abs_error": F.abs(error)})


def quality_report(df: DataFrame, cell: str = "grid_id", ts: str = "datetime") -> DataFrame:
    """Collection report as lines (section, item, value): size, extent, missing values per column."""
    one = df.agg(
        F.count("*").alias("records"), F.count_distinct(cell).alias("cells"), F.count_distinct(ts).alias("times"),
        F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in df.columns])
    lines = [("size", k, F.col(k)) for k in ("records", "cells", "times")]
    lines += [("extent", k, F.col(k)) for k in ("lat_min", "lat_max", "lon_min", "lon_max")]
    lines += [("missing", c, F.col(f"_m_{c}")) for c in df.columns]
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.cast("double").alias("value")) for s, i, v in lines])))
    return rows.where("section <> 'missing' OR value > 0")
