"""Distinct counts that add up: one sketch per part, stored, merged for any range of parts.

Approximate by nature and used by name only; ``stats.coverage`` stays exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a sketch has 2^LG_K registers: 4 KB at most, whatever it has counted
LG_K = 12
#: standard deviation of the relative error of one sketch or of merged ones
SIGMA = 1.04 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, by: Mapping[str, Column], values: Mapping[str, Column]) -> DataFrame:
    """Per group of ``by`` the rows and one sketch for each of ``values``.

    NULL values do not count; a group without values has an empty sketch.  The
    rows are folded before the shuffle, so what travels is a few sketches per
    group and task.
    """
    # the sketch takes whole numbers, strings and bytes
    return df.groupBy(*[c.alias(name) for name, c in by.items()]).agg(
        F.count("*").alias("records"),
        *[F.hll_sketch_agg(c.cast("string"), F.lit(LG_K)).alias(name) for name, c in values.items()])


def merge_sketches(sketches: DataFrame, by: Sequence[str | Column], values: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, as they would be if made from the rows at once."""
    return sketches.groupBy(*by).agg(
        F.sum("records").alias("records"), *[F.hll_union_agg(name).alias(name) for name in values])


def estimates(sketches: DataFrame, values: Sequence[str]) -> DataFrame:
    """The sketches' distinct counts in their place."""
    return sketches.withColumns({name: F.hll_sketch_estimate(name) for name in values})
