"""Categories as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowmill.operators.index import global_index
from rowmill.operators.joins import fits_in_memory, lookup_join

MAX_CATEGORIES = 10_000  # categories that may become columns or one sorted list


def categories(df: DataFrame, field: str, bound: int = MAX_CATEGORIES) -> list | None:
    """Sorted distinct non-null values, or None when there are more than ``bound``."""
    rows = df.where(F.col(field).isNotNull()).select(field).distinct().limit(bound + 1).collect()
    return None if len(rows) > bound else sorted(row[0] for row in rows)


def label_encode(df: DataFrame, field: str) -> DataFrame:
    """``{field}_encoded``: the rank of the value among the sorted distinct values, null first if present.

    Few categories, of few bytes, are ranked by one window over that list and broadcast; beyond that the distinct
    values are indexed by range partitions and joined with salting.
    """
    values = df.select(field).distinct()
    few = fits_in_memory(values, MAX_CATEGORIES)
    if few:
        order = Window.orderBy(F.col(field).asc_nulls_first())  # at most MAX_CATEGORIES rows
        codes = values.select(field, (F.row_number().over(order) - 1).cast("long").alias("_code"))
    else:
        codes = global_index(values, [F.col(field).asc_nulls_first()], "_code")
    joined = lookup_join(df, codes, field, "left", null_safe=True, small=True if few else None)
    return joined.withColumnRenamed("_code", f"{field}_encoded")


def one_hot_encode(df: DataFrame, field: str, values: list | None = None) -> DataFrame:
    """One 0/1 column ``{field}_{value}`` per value, in sorted order."""
    values = categories(df, field) if values is None else values
    if values is None:
        raise ValueError(f"{field} has over {MAX_CATEGORIES} values: use one_hot_long for the same in rows")
    return df.withColumns({
        f"{field}_{value}": F.when(F.col(field) == F.lit(value), 1).otherwise(0) for value in values
    })


def one_hot_long(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """The ones of a one-hot encoding as rows (keys, column): the form for any number of values."""
    return df.where(F.col(field).isNotNull()).select(
        *keys, F.concat(F.lit(f"{field}_"), F.col(field).cast("string")).alias("column"))


def target_means(df: DataFrame, category: str, target: str) -> DataFrame:
    """Mean target per category over rows where both are present."""
    present = df.where(F.col(category).isNotNull() & F.col(target).isNotNull())
    return present.groupBy(category).agg(F.avg(target).alias("mean_target"))


def target_encode(df: DataFrame, category: str, target: str) -> DataFrame:
    """``{category}_encoded``: the category's mean target on every record."""
    means = target_means(df, category, target).withColumnRenamed("mean_target", f"{category}_encoded")
    return lookup_join(df, means, category, "left")


def encode(df: DataFrame, field: str, method: str = "label", target: str | None = None) -> DataFrame:
    if method == "label":
        return label_encode(df, field)
    if method == "one_hot":
        return one_hot_encode(df, field)
    if method == "target" and target:
        return target_encode(df, field, target)
    return df
