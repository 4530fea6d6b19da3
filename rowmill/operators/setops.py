"""Union by name, difference of snapshots and change rows between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, duplicates kept; the columns are the sorted union, missing ones null.

    A column that is text in one input and something else in another is text in the result.
    """
    kinds: dict[str, set] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {name for name, found in kinds.items() if len(found) > 1 and "string" in found}
    frames = [f.withColumns({c: F.col(f"`{c}`").cast("string") for c in f.columns if c in mixed}) if mixed else f for f in frames]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*sorted(merged.columns))


def snapshot_changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether two results differ as multisets of rows."""
    columns = sorted(new.columns)
    if sorted(old.columns) != columns:
        return True
    a, b = old.select(*columns), new.select(*columns)
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def poll_result(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The full new result if it differs from the last one, else no rows."""
    changed = old is None or snapshot_changed(old, new)
    return new if changed else new.limit(0)


def change_rows(old: DataFrame, new: DataFrame, key: str, table: str) -> DataFrame:
    """INSERT, UPDATE and DELETE rows that lead from one snapshot to the next, with the data as JSON."""
    columns = [c for c in new.columns if c != key]
    was = old.select(F.col(key).alias("_old_key"), F.struct(*old.columns).alias("_old"))
    now = new.select(F.col(key).alias("_new_key"), F.struct(*new.columns).alias("_new"))
    both = was.join(now, F.col("_old_key") == F.col("_new_key"), "full")
    differs = ~F.struct(*[F.col(f"_old.{c}") for c in columns]).eqNullSafe(
        F.struct(*[F.col(f"_new.{c}") for c in columns]))
    operation = (
        F.when(F.col("_old_key").isNull(), "INSERT")
        .when(F.col("_new_key").isNull(), "DELETE")
        .when(differs, "UPDATE")
    )
    return (
        both.select(operation.alias("operation"), F.lit(table).alias("table"),
                    F.coalesce("_new_key", "_old_key").alias(key),
                    F.coalesce("_new", "_old").alias("data"))
        .where(F.col("operation").isNotNull())
    )
