"""Exact quantiles without gathering a group in one task.

The rows are read twice.  The first reading makes a mergeable quantile sketch per
group, which brackets each wanted rank.  The second folds equal values inside the
brackets into counts, and all rows of a gap between brackets into one count, so
what is stored is a few hundredths of the rows at most and still has every rank
in its place.  A rank that falls into a gap (the sketch errs by chance) sends its
group through a third reading, in which all its values are folded.

Among the stored counts the value axis is narrowed round by round: count per
bucket (combined before the shuffle), find the bucket that holds each wanted
rank, look closer at those buckets only.  A bucket is cut between its smallest and
its largest value, which fall into different parts, so every round leaves fewer
distinct values and the search ends by itself.  Infinities are values of their own
and are counted apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

# first round: about ten thousand buckets per factor of e, whatever the data's range
_LOG_STEPS = 10_000.0
_LOG_UNIT = 1e-3
# later rounds: linear parts of the bucket in view
_PARTS = 4096

#: size of a sketch: about 3,000 values whatever it has seen
SKETCH_K = 1024
#: half width of a bracket as a share of the rows: twice the sketch's error at 99 % confidence
REACH = 2 * 2.296 / SKETCH_K ** 0.9021
#: rows on each side of a wanted rank that a bracket spans at least, for the rank's rounding in small groups
LEAST_REACH = 2


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``by``, ``n`` (values present), one column per entry of ``probs``.

    Quantiles interpolate linearly between neighbouring values.  NULL and NaN do
    not count; a group without values is absent.
    """
    v = F.col(value).cast("double")
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    grouped = [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    rows = df.select(*grouped, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    brackets = stored(_brackets(rows, probs, keys), "brackets")
    folded = stored(_between_brackets(rows, brackets, len(probs), keys), "values")
    found = _search(folded, probs, keys)
    beside = _beside(found, brackets, keys)
    sure = F.lit(True)
    for k in range(len(probs)):
        sure = sure & F.col(f"_{k}_0").between(F.col(f"_low{k}"), F.col(f"_high{k}"))
        sure = sure & F.col(f"_{k}_1").between(F.col(f"_low{k}"), F.col(f"_high{k}"))
    missed = beside.where(~sure).select(*keys)
    if not missed.isEmpty():
        again = stored(_beside(rows, missed, keys).groupBy(*keys, "_v").agg(F.count("*").alias("_w")), "values")
        found = beside.where(sure).select(*found.columns).unionByName(_search(again, probs, keys))
    names = [F.col(k).alias(b) for b, k in zip(by, keys)]
    return _interpolated(found, probs).select(*names, "n", *probs)


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the group; NULL groups meet too."""
    renamed = right.withColumnsRenamed({k: f"b{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b{k}"))
    return left.join(renamed, same).drop(*[f"b{k}" for k in keys])


def _brackets(rows: DataFrame, probs: Mapping[str, float], keys: list[str]) -> DataFrame:
    """Per group and wanted quantile ``k`` the interval ``_low{k}`` to ``_high{k}`` that should hold both of its ranks."""
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("_sketch"))
    small = F.col("_total") * REACH < LEAST_REACH
    ends = []
    for k, p in enumerate(probs.values()):
        low, high = (F.kll_sketch_get_quantile_double("_sketch", F.lit(min(1.0, max(0.0, p + side)))) for side in (-REACH, REACH))
        ends += [F.when(small | F.lit(p <= REACH), F.col("_least")).otherwise(low).alias(f"_low{k}"),
                 F.when(small | F.lit(p >= 1 - REACH), F.col("_most")).otherwise(high).alias(f"_high{k}")]
    return made.select(*keys, *ends)


def _between_brackets(rows: DataFrame, brackets: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Counts ``_w`` of each value inside a bracket, and of each gap between brackets under its smallest value."""
    v = F.col("_v")
    inside, gap = F.lit(False), F.lit(0)
    for k in range(n):
        inside = inside | v.between(F.col(f"_low{k}"), F.col(f"_high{k}"))
        gap = gap + (F.col(f"_high{k}") < v).cast("int")
    return _beside(rows, brackets, keys).groupBy(
        *keys, F.when(inside, v).alias("_in"), F.when(~inside, gap).alias("_gap")).agg(
        F.min("_v").alias("_v"), F.count("*").alias("_w")).drop("_in", "_gap")


def _log_bucket(v: Column) -> Column:
    # the largest doubles overflow in the division and share one bucket below the infinities
    size = F.least(F.log1p(F.abs(v) / _LOG_UNIT) * _LOG_STEPS, F.lit(1e8))
    return F.when(F.abs(v) == float("inf"), F.signum(v) * F.lit(1e9)).otherwise(F.signum(v) * F.floor(size)).cast("long")


def _search(folded: DataFrame, probs: Mapping[str, float], keys: list[str]) -> DataFrame:
    histogram = folded.groupBy(*keys, _log_bucket(F.col("_v")).alias("_b")).agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # a group has at most about fourteen million log buckets, those of its brackets only
    ordered = W.partitionBy(*keys)
    counted = (
        histogram
        .withColumn("_end", F.sum("_n").over(ordered.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(ordered))
    )
    wanted = F.array(*[
        F.struct(F.lit(k).alias("name"), F.lit(side).alias("side"),
                 turn(F.lit(float(p)) * (F.col("_total") - 1)).alias("rank"))
        for k, p in enumerate(probs.values()) for side, turn in ((0, F.floor), (1, F.ceil))
    ])
    # a target: a wanted rank, counted inside the interval [_lo, _hi]
    begin = F.col("_end") - F.col("_n")
    targets = stored(
        counted.withColumn("_t", F.explode(wanted))
        .where((F.col("_t.rank") < F.col("_end")) & (F.col("_t.rank") >= begin))
        .select(*keys, "_total", F.col("_t.name").alias("_name"), F.col("_t.side").alias("_side"),
                (F.col("_t.rank") - begin).alias("_rank"), "_lo", "_hi"), "targets")
    done = targets.where("_lo = _hi")
    open_targets = targets.where("_lo < _hi")
    while not open_targets.isEmpty():
        closer = stored(_look_closer(folded, open_targets, keys), "targets")
        done = done.unionByName(closer.where("_lo = _hi"))
        open_targets = closer.where("_lo < _hi")

    sides = [
        F.max(F.when((F.col("_name") == k) & (F.col("_side") == side), F.col("_lo"))).alias(f"_{k}_{side}")
        for k in range(len(probs)) for side in (0, 1)
    ]
    return done.groupBy(*keys).agg(F.max("_total").alias("n"), *sides)


def _interpolated(found: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    per_name = []
    for k, (name, p) in enumerate(probs.items()):
        position = F.lit(float(p)) * (F.col("n") - 1)
        share = position - F.floor(position)
        low, high = F.col(f"_{k}_0"), F.col(f"_{k}_1")
        per_name.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return found.select("*", *per_name)


def _look_closer(folded: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Split every interval in view into parts and keep the part that holds the rank."""
    # intervals of one group never overlap, so a value falls into one of them at most
    intervals = targets.select(*keys, "_lo", "_hi").distinct()
    named = [F.col(k).alias(f"i{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"i{k}"))
    inside = folded.join(intervals.select(*named, "_lo", "_hi"), same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    # halves keep the width finite
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    part = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), _PARTS).otherwise(
        F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1)))
    interval = [*keys, "_lo", "_hi"]
    parts = inside.groupBy(*interval, part.alias("_p")).agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_new_lo"), F.max("_v").alias("_new_hi"))
    running = W.partitionBy(*interval).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("_end", F.sum("_n").over(running)).select(
        *[F.col(k).alias(f"p{k}") for k in interval], "_n", "_new_lo", "_new_hi", "_end")
    match = F.lit(True)
    for k in interval:
        match = match & F.col(k).eqNullSafe(F.col(f"p{k}"))
    begin = F.col("_end") - F.col("_n")
    return targets.join(parts, match & (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= begin)).select(
        *keys, "_total", "_name", "_side", (F.col("_rank") - begin).alias("_rank"),
        F.col("_new_lo").alias("_lo"), F.col("_new_hi").alias("_hi"))
