"""Sinks for result tables, metric records and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write a result table, partitioned on request.

    ``overwrite`` replaces the whole table, ``overwrite_partitions`` only the
    partitions that the rows fall into, ``append`` adds.

    Before a partitioned write the rows are rebalanced on the partition
    columns: adaptive execution joins small pieces into whole files and splits
    a partition value that holds a large share of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if mode == "overwrite_partitions":
        if not partition_by:
            raise ValueError("overwrite_partitions needs partition columns")
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    else:
        writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def metrics_document(metrics: DataFrame, name: str, features: Sequence[str],
                     parameters: Mapping[str, float], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One nested record from a one-row metrics table (mae, rmse, r2, n).

    ``best_model`` holds name, metrics and parameters, ``dataset_info`` the
    sample count, the features and whatever ``extra`` adds.
    """
    settings = F.map_from_entries(F.array(*[
        F.struct(F.lit(k), F.lit(float(v))) for k, v in parameters.items()
    ]))
    details = [v.alias(k) for k, v in (extra or {}).items()]
    return metrics.select(
        F.struct(F.lit(name).alias("name"), "mae", "rmse", "r2", settings.alias("parameters")).alias("best_model"),
        F.struct(
            F.col("n").alias("total_samples"),
            F.array(*[F.lit(f) for f in features]).alias("features_used"),
            *details,
        ).alias("dataset_info"),
    )


def as_json(document: DataFrame) -> DataFrame:
    """The record as one line of JSON text."""
    return document.select(F.to_json(F.struct("*")).alias("document"))


def write_document(document: DataFrame, path: str) -> str:
    document.write.mode("overwrite").json(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """Write (section, item, value) lines as text."""
    line = F.concat_ws("", F.col("section"), F.lit(" | "), F.col("item"), F.lit(": "), F.col("value"))
    report.select(line.alias("value")).write.mode("overwrite").text(path)
    return path
