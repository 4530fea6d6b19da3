"""Groups of any size: frequent keys are found first and then split over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowmill.operators.index import as_columns, global_index
from rowmill.operators.joins import lookup_join
from rowmill.session import shared_dir, shuffle_partitions

GROUP_ROWS = 100_000     # a group of up to this many rows may be held in memory by one task
RANKED_ROWS = 1_000_000  # a group of up to this many rows may be sorted, and spilled, by one task


def hot_keys(df: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``max_rows`` (GROUP_ROWS) rows, or None. There are at most rows / max_rows of them."""
    max_rows = GROUP_ROWS if max_rows is None else max_rows
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > max_rows).drop("_rows")
    )
    return None if hot.isEmpty() else hot


def collect_parts(df: DataFrame, keys: list[str], order_by, fields: dict[str, Column],
                  max_items: int = GROUP_ROWS, items: str = "items", part: str = "part") -> DataFrame:
    """One row per group with its rows as an array of structs, in order.

    A group with more than ``max_items`` rows continues in further rows, numbered by ``part`` from 0: its rows get
    positions from a range partitioning by the order and are cut every ``max_items`` rows, so no task holds a whole
    group. With a unique order the parts are the same on every run.
    """
    order = as_columns(order_by)
    order_names = [f"_o{i}" for i in range(len(order))]
    flat = df.select(*keys, *[c.alias(n) for c, n in zip(order, order_names)],
                     *[c.alias(f"_f_{n}") for n, c in fields.items()])
    packed = F.struct(*order_names, *[F.col(f"_f_{n}").alias(n) for n in fields])
    ordered = F.array_sort(F.collect_list(packed))
    plain = F.transform(ordered, lambda x: F.struct(*[x[n].alias(n) for n in fields]))

    def gathered(rows: DataFrame, group: list[str]) -> DataFrame:
        return rows.groupBy(*group).agg(plain.alias(items))

    hot = hot_keys(flat, keys, max_items)
    if hot is None:
        return gathered(flat, keys).select(*keys, F.lit(0).cast("long").alias(part), items)
    usual = lookup_join(flat, hot, keys, "left_anti", null_safe=True)
    frequent = lookup_join(flat, hot, keys, "left_semi", null_safe=True)
    placed = global_index(frequent, [*keys, *order_names], "_at")
    firsts = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))  # one row per frequent key
    laid_out = lookup_join(placed, firsts, keys, "inner", null_safe=True).withColumn(
        part, F.floor((F.col("_at") - F.col("_first")) / F.lit(max_items)).cast("long"))
    return (
        gathered(usual, keys).select(*keys, F.lit(0).cast("long").alias(part), items)
        .unionByName(gathered(laid_out, [*keys, part]))
    )


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict) -> DataFrame:
    """Exact values at sorted positions of each group (keys, n and one column per pick), for groups of any size.

    ``picks`` maps an output name to a function that turns a group's count of non-null values into a 0-based position.
    Equal values of a group are counted first. The distinct ones are range-partitioned by group and value and kept as a
    checkpoint, since range bounds come from a sample. Sums per partition and group give every partition's
    first position; only the partitions that hold a wanted position are read again, and there a running count finds
    the value. So a group is spread over tasks by its values, and no task depends on the size of a group.
    """
    spark = df.sparkSession
    shared_dir(spark)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    laid = (counts.repartitionByRange(shuffle_partitions(spark), *keys, "_v").sortWithinPartitions(*keys, "_v")
            .withColumn("_part", F.spark_partition_id()).checkpoint())
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("_part", *keys).agg(F.sum("_c").alias("_sum")).withColumns(
        {"_n": F.sum("_sum").over(group), "_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0))})
    places = F.array(*[F.struct(F.lit(name).alias("pick"), (position(F.col("_n")) - F.col("_before")).cast("long").alias("at"))
                       for name, position in picks.items()])
    wanted = sums.select("_n", F.filter(places, lambda p: (p["at"] >= 0) & (p["at"] < F.col("_sum"))).alias("_places"),
                         *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p")).where(F.size("_places") > 0)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = laid.join(wanted, same).withColumn("_upto", F.sum("_c").over(inside))
    found = near.select(*keys, "_n", "_v", F.explode(F.filter(
        "_places", lambda p: (p["at"] < F.col("_upto")) & (p["at"] >= F.col("_upto") - F.col("_c")))).alias("_hit"))
    return found.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_hit.pick") == name, F.col("_v"))).alias(name) for name in picks])


MEDIAN_PICKS = {"mid_low": lambda n: F.floor((n - 1) / 2), "mid_high": lambda n: F.floor(n / 2)}


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    found = order_statistics(df, keys, value, MEDIAN_PICKS)
    return found.select(*keys, ((F.col("mid_low") + F.col("mid_high")) / 2).cast("double").alias(name))
