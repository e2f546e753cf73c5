"""The index and its categories as temporary SQL functions.

Each is an SQL expression that the optimizer puts in place of the call, so a
query that uses it plans like one that spells it out: no Python, filters on its
arguments still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed

_ABSENT = "WHEN pm IS NULL OR isnan(pm) THEN NULL"


def _index() -> str:
    arms, low, index_low = [_ABSENT], 0.0, 0.0
    for k, (_, high, index_high) in enumerate(fixed.CPCB_BANDS):
        line = f"{index_low}D + (pm - {low}D) * {index_high - index_low}D / {high - low}D"
        last = k == len(fixed.CPCB_BANDS) - 1
        arms.append(f"ELSE least({fixed.CPCB_INDEX_MAX}D, {line})" if last else f"WHEN pm <= {high}D THEN {line}")
        low, index_low = high, index_high
    return "CASE " + " ".join(arms) + " END"


def _banded(limits: list[float], labels: list, quote: str = "'") -> str:
    arms = [f"WHEN pm <= {limit}D THEN {quote}{label}{quote}" for limit, label in zip(limits, labels)]
    return " ".join(["CASE", _ABSENT, *arms, f"ELSE {quote}{labels[-1]}{quote} END"])


def definitions() -> dict[str, tuple[str, str]]:
    """Type and body of every function of one argument ``pm``."""
    cpcb, epa = fixed.CPCB_BANDS, fixed.EPA_BANDS
    ladders = {
        f"advisory_level_{name}": ("INT", _banded(limits, list(range(len(limits) + 1)), ""))
        for name, limits in fixed.ADVISORY_LIMITS.items()}
    return {
        "cpcb_aqi": ("DOUBLE", _index()),
        "cpcb_category": ("STRING", _banded([b[1] for b in cpcb[:-1]], [b[0] for b in cpcb])),
        "epa_category": ("STRING", _banded([b[1] for b in epa], [b[0] for b in epa] + [fixed.EPA_TOP])),
        **ladders,
    }


def register(spark: SparkSession) -> list[str]:
    """Define the functions in the session, replacing those of the same names; returns the names."""
    made = definitions()
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(pm DOUBLE) RETURNS {kind} RETURN {body}")
    return list(made)
