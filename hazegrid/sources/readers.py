"""Scans, source choice, snapshots and the schema contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str | list[str], schema: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a table with a declared schema; text formats never infer types.

    ``fmt`` is any Spark file format; ``csv`` files carry a header line.
    """
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def clean_readings(df: DataFrame) -> DataFrame:
    """NaN becomes NULL; the ground-truth flag, text or number, becomes a boolean."""
    columns = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double"))
        for f in df.schema.fields if f.dataType.typeName() in ("double", "float")
    }
    if "has_ground_truth" in df.columns:
        columns["has_ground_truth"] = as_flag("has_ground_truth")
    return df.withColumns(columns) if columns else df


def as_flag(name: str) -> Column:
    return F.lower(F.col(name).cast("string")).isin("true", "1", "1.0")


def first_available(spark: SparkSession, paths: Sequence[str], any_of_cols: Sequence[str],
                    fmt: str = "parquet", schema: str | None = None) -> tuple[str, DataFrame]:
    """The first source in the list that exists and has one of the columns.

    Looks at paths and schemas only; no rows are read.  A path that is absent is
    passed over, a source that cannot be read raises.  Text formats without a
    ``schema`` come back as strings.
    """
    for path in paths:
        try:
            # a text source's own header says which columns it has
            reader = spark.read.option("header", True) if fmt == "csv" else spark.read
            df = reader.format(fmt).load(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        if any(c in df.columns for c in any_of_cols):
            return path, read_table(spark, path, schema, fmt) if schema else df
    raise LookupError(f"no source among {list(paths)} has one of {list(any_of_cols)}")


def latest_snapshot(df: DataFrame, snapshot_col: str) -> DataFrame:
    """Rows of the newest snapshot in a table that holds several.

    The newest value is a scalar subquery, so on a partition column only that
    partition is read.
    """
    newest = df.agg(F.max(snapshot_col)).scalar()
    return df.where(F.col(snapshot_col) == newest)


def latest_file(spark: SparkSession, folders: Sequence[str], pattern: str) -> str:
    """Path of the newest file that fits ``pattern`` in any of the folders.

    Only the file listing is read, never the contents; missing folders are skipped.
    """
    listings = []
    for folder in folders:
        try:
            found = (
                spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
                .select("path", "modificationTime")
            )
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        listings.append(found)
    if not listings:
        raise LookupError(f"none of {list(folders)} exists")
    newest = reduce(DataFrame.unionByName, listings).orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise LookupError(f"no file fits {pattern!r}")
    return newest["path"]


def ensure_columns(df: DataFrame, required: Sequence[str],
                   defaults: Mapping[str, Column]) -> DataFrame:
    """Fail on missing required columns; derive the optional ones that are absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    absent = {c: value for c, value in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def union_snapshots(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column absent from one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
