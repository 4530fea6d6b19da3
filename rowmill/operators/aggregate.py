"""Grouped aggregation from ``{output: "function,field"}`` specifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.operators.groups import collect_parts, exact_median, hot_keys
from rowmill.operators.index import as_columns, order_value

FUNCTIONS = ("sum", "count", "mean", "avg", "min", "max", "std", "first", "last", "list", "median", "mode")
_ONE_GROUP = "_all"
MEDIAN_ROWS = 250_000  # Spark's median keeps the distinct values of a group in memory


def parse_spec(spec: str) -> tuple[str, str | None]:
    parts = [piece.strip() for piece in spec.split(",")]
    return parts[0], parts[1] if len(parts) > 1 else None


def _without_field(function: str) -> Column:
    if function in ("sum", "mean", "avg", "std", "median"):
        return F.lit(0.0)
    if function == "list":
        return F.array().cast("array<string>")
    return F.lit(None).cast("string")


def _one_pass(function: str, field: str, order: list[Column] | None) -> Column | None:
    """The aggregate for functions that one hash aggregation computes."""
    c = F.col(field)
    if function == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if function in ("mean", "avg"):
        return F.coalesce(F.avg(c), F.lit(0.0))
    if function == "min":
        return F.min(c)
    if function == "max":
        return F.max(c)
    if function == "std":
        return F.coalesce(F.stddev_pop(c), F.lit(0.0))
    if function in ("first", "last"):
        if not order:
            raise ValueError(f"{function} needs order_by")
        pick = F.min_by if function == "first" else F.max_by
        return pick(c, order_value(order))
    return None


def most_common(df: DataFrame, keys: list[str], field: str, order_by, name: str) -> DataFrame:
    """The most frequent non-null value per group; of equally frequent ones the first seen."""
    seen = (
        df.where(F.col(field).isNotNull())
        .groupBy(*keys, F.col(field).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min(order_value(order_by)).alias("_first"))
    )
    return seen.groupBy(*keys).agg(F.min_by("_v", F.struct((-F.col("_c")).alias("c"), "_first")).alias(name))


def _join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_k_{key}")
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])


def aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, str], order_by=None,
              max_items: int | None = None) -> DataFrame:
    """Group and summarise; null is a group of its own, and no records give no rows.

    Everything but mode, list and the median of very large groups is computed in one aggregation. A
    ``list`` output adds the column ``part``: a group with more than ``max_items`` rows continues in further
    rows (see :func:`collect_parts`), which carry the lists only; the other outputs stand in part 0 and are null in
    later parts, so that they count once.
    """
    specs = {name: parse_spec(spec) for name, spec in aggregations.items()}
    keys = list(group_by)
    source = df
    if not keys:
        keys, source = [_ONE_GROUP], df.withColumn(_ONE_GROUP, F.lit(1))
    order = as_columns(order_by) if order_by is not None else None
    medians = [n for n, (f, c) in specs.items() if f == "median" and c]
    split_median = bool(medians) and hot_keys(source, keys, MEDIAN_ROWS) is not None

    columns, later = [], []
    for name, (function, field) in specs.items():
        if function == "count":
            columns.append(F.count(F.lit(1)).alias(name))
        elif function not in FUNCTIONS or field is None:
            columns.append(F.first(_without_field(function)).alias(name))
        elif function == "median" and not split_median:
            columns.append(F.coalesce(F.median(field), F.lit(0.0)).alias(name))
        elif function in ("median", "mode", "list"):
            later.append((name, function, field))
        else:
            columns.append(_one_pass(function, field, order).alias(name))
    result = source.groupBy(*keys).agg(*(columns or [F.count(F.lit(1)).alias("_count")]))

    if any(f in ("mode", "list") for _, f, _ in later) and order is None:
        raise ValueError("mode and list need order_by")
    lists = {name: field for name, function, field in later if function == "list"}
    for name, function, field in later:
        if function == "median":
            result = _join_on_keys(result, exact_median(source, keys, field, name), keys)
            result = result.withColumn(name, F.coalesce(name, F.lit(0.0)))
        elif function == "mode":
            result = _join_on_keys(result, most_common(source, keys, field, order_by, name), keys)
    if lists:
        bound = {} if max_items is None else {"max_items": max_items}
        # one cut for all lists, so that their parts hold the same records
        parts = collect_parts(source, keys, order_by, {n: F.col(c) for n, c in lists.items()}, items="_items", **bound)
        parts = parts.select(*keys, "part", *[F.col("_items").getField(n).alias(n) for n in lists])
        scalars = [n for n in specs if n not in lists]
        result = _join_on_keys(result, parts, keys).withColumns({n: F.when(F.col("part") == 0, F.col(n)) for n in scalars})
    outputs = [*group_by, *specs, *(["part"] if lists else [])]
    return result.select(*outputs)


def aggregate_simple(df: DataFrame, group_by: str, function: str, field: str, order_by=None) -> DataFrame:
    """One function over one field, as column ``result``."""
    return aggregate(df, [group_by], {"result": f"{function},{field}"}, order_by)
