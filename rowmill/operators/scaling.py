"""Scaling of numeric fields by statistics of the whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.functions.numbers import numeric_fields
from rowmill.operators.groups import order_statistics

METHODS = ("min_max", "z_score", "robust")

_ROBUST = {
    "q1": lambda n: F.floor(n / 4),
    "mid": lambda n: F.floor(n / 2),
    "q3": lambda n: F.floor(n / 4) * 3,
}


def long_numbers(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (field, value) for the given numeric fields."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields
    ])).alias("_x")).select("_x.*")


def _statistics(df: DataFrame, fields: list[str], method: str, fixed: dict) -> Column:
    """One struct with the needed statistics of every field, as a scalar subquery."""
    if method == "robust":
        found = order_statistics(long_numbers(df, fields), ["field"], "value", _ROBUST)
        parts = [F.max(F.when(F.col("field") == f, F.col(p))).alias(f"{p}_{i}")
                 for i, f in enumerate(fields) for p in _ROBUST]
        return found.agg(F.struct(*parts).alias("s")).scalar()
    parts = []
    for i, f in enumerate(fields):
        c = F.col(f).cast("double")
        if method == "z_score":
            parts += [F.avg(c).alias(f"mean_{i}"), F.stddev_pop(c).alias(f"std_{i}")]
        else:
            low, high = fixed.get(f, (None, None))
            parts += [(F.min(c) if low is None else F.lit(float(low))).alias(f"min_{i}"),
                      (F.max(c) if high is None else F.lit(float(high))).alias(f"max_{i}")]
    return df.agg(F.struct(*parts).alias("s")).scalar()


def normalize(df: DataFrame, fields: list[str], method: str = "min_max",
              bounds: dict[str, tuple] | None = None) -> DataFrame:
    """Add ``{field}_normalized`` for every numeric field; other fields are skipped, null stays null.

    ``bounds`` fixes (min, max) of a field for min_max. An unknown method means min_max. All statistics
    come from one aggregation whose single row enters the projection as a scalar subquery.
    """
    method = method if method in METHODS else "min_max"
    numeric = set(numeric_fields(df))
    fields = [f for f in fields if f in numeric]
    if not fields:
        return df
    stats = _statistics(df, fields, method, bounds or {})
    outputs = {}
    for i, f in enumerate(fields):
        v = F.col(f).cast("double")
        if method == "min_max":
            low, width, flat = stats[f"min_{i}"], stats[f"max_{i}"] - stats[f"min_{i}"], 0.5
        elif method == "z_score":
            low, width, flat = stats[f"mean_{i}"], stats[f"std_{i}"], 0.0
        else:
            low, width, flat = stats[f"mid_{i}"], stats[f"q3_{i}"] - stats[f"q1_{i}"], 0.0
        scaled = F.when(width == 0, F.lit(flat)).otherwise((v - low) / F.nullif(width, F.lit(0.0)))
        outputs[f"{f}_normalized"] = F.when(v.isNotNull(), scaled)
    return df.withColumns(outputs)
