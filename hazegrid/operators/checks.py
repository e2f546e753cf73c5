"""Data checks and derived columns that need a look at other rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .quantiles import exact_quantiles
from .stats import with_keys


def outlier_flags(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Add ``negative`` and ``outlier`` (beyond 1.5 interquartile ranges of the group)."""
    quartiles = exact_quantiles(df, column, {"q25": 0.25, "q75": 0.75}, by).drop("n")
    reach = (F.col("q75") - F.col("q25")) * 1.5
    beyond = ~F.col(column).between(F.col("q25") - reach, F.col("q75") + reach)
    return with_keys(df, quartiles, by).withColumns(
        {"negative": F.col(column) < 0, "outlier": F.coalesce(beyond, F.lit(False))}).drop("q25", "q75")


def temporal_checks(df: DataFrame, station: str, ts: str, column: str, step_hours: float, spike: float) -> DataFrame:
    """Add ``gap_hours`` to the reading before, ``duplicate``, ``gap`` and ``spike``.

    Readings are compared inside a station and day, a group that stays small;
    the last reading before the day is carried in from a table of day ends.
    """
    day = F.date_trunc("day", F.col(ts))
    rows = df.withColumn("_day", day)
    ends = rows.groupBy(station, "_day").agg(
        F.max(F.struct(F.col(ts).alias("_t"), F.col(column).alias("_v"))).alias("_end"))
    # one row per station and day: narrow, and as long as the time that a station reports
    carried = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(station).orderBy("_day"))).select(
        station, "_day", "_carry")
    order = W.partitionBy(station, "_day").orderBy(ts, column)
    before = F.coalesce(F.lag(F.struct(F.col(ts).alias("_t"), F.col(column).alias("_v"))).over(order), F.col("_carry"))
    joined = rows.join(carried, [station, "_day"]).withColumn("_before", before)
    hours = (F.col(ts).cast("double") - F.col("_before._t").cast("double")) / 3600
    return joined.withColumns({"gap_hours": hours}).withColumns({
        "duplicate": F.coalesce(F.col("gap_hours") == 0, F.lit(False)),
        "gap": F.coalesce(F.col("gap_hours") > step_hours, F.lit(False)),
        "spike": F.coalesce(F.abs(F.col(column) - F.col("_before._v")) > spike, F.lit(False)),
    }).drop("_day", "_carry", "_before")


def temporal_folds(df: DataFrame, ts: str, folds: int) -> DataFrame:
    """Add ``fold`` 1..n in time order, of about equal size, cut between days.

    Cut-offs come from the counts per day; no global sort of the rows.
    """
    days = df.groupBy(F.to_date(ts).alias("_day")).agg(F.count("*").alias("_n"))
    # one row per day
    running = F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    total = days.agg(F.sum("_n")).scalar()
    marked = days.select("_day", (F.floor(F.coalesce(running, F.lit(0)) * folds / total) + 1).cast("int").alias("fold"))
    return df.withColumn("_day", F.to_date(ts)).join(marked, "_day").drop("_day")


def forward_splits(df: DataFrame, ts: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each fold in time order but the first: all earlier folds to train on, and the fold itself.

    Folds are cut between days, so no training day is a test day or follows one.
    """
    marked = stored(temporal_folds(df, ts, folds), "time-folds")
    return [(marked.where(F.col("fold") < k).drop("fold"), marked.where(F.col("fold") == k).drop("fold"))
            for k in range(2, folds + 1)]


def block_fold(lat_cell: Column, lon_cell: Column, size: int, folds: int) -> Column:
    """Fold of a cell, 1..n: square blocks of ``size`` cells fall together."""
    return (F.pmod(F.floor(lat_cell / size) * 31 + F.floor(lon_cell / size), F.lit(folds)) + 1).cast("int")


def station_splits(df: DataFrame, lat_cell: str, lon_cell: str, folds: int, size: int,
                   guard: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each spatial fold: the rows outside of it and of a band of ``guard`` cells around it, and the fold's rows.

    A cell's fold is arithmetic on its numbers, and so is that of the cells
    around it: nothing is joined.  The band may be as wide as a block.
    """
    if not 0 <= guard <= size:
        raise ValueError("the band is wider than a block")
    steps = (-guard, 0, guard) if guard else (0,)
    around = [block_fold(F.col(lat_cell) + i, F.col(lon_cell) + j, size, folds) for i in steps for j in steps]
    own = block_fold(F.col(lat_cell), F.col(lon_cell), size, folds)
    return [(df.where(reduce(Column.__and__, [f != k for f in around])), df.where(own == k)) for k in range(1, folds + 1)]


def spatial_folds(lat_cell: Column, lon_cell: Column, folds: int) -> Column:
    """Fold of a cell, 1..n; all rows of a cell fall together."""
    return (F.pmod(lat_cell * 31 + lon_cell, F.lit(folds)) + 1).cast("int")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add z-scores ``<column>_z``; mean and sample deviation are scalar subqueries of one aggregation each."""
    out = {}
    for c in columns:
        one = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
        out[f"{c}_z"] = (F.col(c) - one.select("m").scalar()) / one.select("s").scalar()
    return df.withColumns(out)


def impute_mean(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill absent values with the column's mean over ``fit_on`` (all rows by default)."""
    base = df if fit_on is None else fit_on
    means = base.agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c), means.select(c).scalar()) for c in columns})


def forecast_interval(df: DataFrame, actual: str, predicted: str, by: Sequence[str],
                      low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Add ``lower`` and ``upper``: the prediction plus residual quantiles of its group."""
    rows = df.withColumn("_residual", F.col(actual) - F.col(predicted))
    spread = exact_quantiles(rows, "_residual", {"_low": low, "_high": high}, by).drop("n")
    return with_keys(rows, spread, by).withColumns({
        "lower": F.col(predicted) + F.col("_low"), "upper": F.col(predicted) + F.col("_high"),
    }).drop("_residual", "_low", "_high")


def daily_trend(df: DataFrame, ts: str, column: str, by: Sequence[str] = (), days: int = 7) -> DataFrame:
    """Daily mean; over the last ``days`` days with readings its mean and its slope a day (NULL for a single day)."""
    daily = df.groupBy(*by, F.to_date(ts).alias("day")).agg(F.avg(column).alias("mean"))
    # one row per group and day
    last = W.partitionBy(*by).orderBy("day").rowsBetween(1 - days, 0)
    number = F.datediff("day", F.lit("1970-01-01")).cast("double")
    return daily.withColumns({"trend": F.avg("mean").over(last), "slope": F.regr_slope(F.col("mean"), number).over(last)})
