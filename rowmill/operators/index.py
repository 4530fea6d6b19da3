"""Positions of rows in an explicit order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.session import shared_dir, shuffle_partitions

_SLOT = "_slot"


def as_columns(order_by) -> list[Column]:
    items = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(item) if isinstance(item, str) else item for item in items]


def order_value(order_by) -> Column:
    """One comparable value per row: the order column itself, or a struct of several.

    A single fixed-width column lets minimum and maximum run in a hash aggregation.
    """
    keys = as_columns(order_by)
    return keys[0] if len(keys) == 1 else F.struct(*keys)


def global_index(df: DataFrame, order_by, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of every row in the order of ``order_by`` (a unique key).

    The rows are range-partitioned and sorted once, then checkpointed: range bounds come from a
    sample, so a second evaluation could place rows elsewhere. The offsets that turn a position in a
    partition into a global one are one number per partition.
    """
    spark = df.sparkSession
    shared_dir(spark)
    keys = as_columns(order_by)
    laid_out = (
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftrightunsigned(F.col(_SLOT), 33).cast("int")
    sizes = laid_out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, seen = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], seen))
        seen += row["n"]
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    position = F.col("_start") + F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, position)
        .drop("_part", "_start", _SLOT)
    )
