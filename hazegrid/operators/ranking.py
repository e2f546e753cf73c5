"""Order, choice and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, column: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` largest rows; ``ties`` make the choice definite."""
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(k)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones however the data is partitioned."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), *key).limit(n)


def worst_row(df: DataFrame, column: str, order: str, by: Sequence[str]) -> DataFrame:
    """Per group the row with the largest value, the first in ``order`` of equal ones, by a combinable minimum."""
    rest = [c for c in df.columns if c not in by]
    rows = df.where(F.col(column).isNotNull())
    key = F.struct((-F.col(column)).alias("_v"), F.col(order).alias("_o"), F.struct(*rest).alias("_r"))
    return rows.groupBy(*by).agg(F.min(key).alias("_m")).select(*by, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


def choose_best(metrics: DataFrame, score: str, priority: Column) -> DataFrame:
    """The row with the largest score; of equal ones that with the smallest priority."""
    return metrics.orderBy(F.desc_nulls_last(score), priority).limit(1)
