"""Ways to renew a table from new data; each returns the rows to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowmill.operators import groups
from rowmill.operators.index import global_index
from rowmill.operators.joins import first_per_key, lookup_join


def newer_rows(target: DataFrame, source: DataFrame, mark: str) -> DataFrame:
    """Source rows beyond the target's highest id or time; all of them when the target is empty."""
    highest = target.agg(F.max(mark).alias("m")).scalar()
    return source.where(highest.isNull() | (F.col(mark) > highest))


def incremental(target: DataFrame, source: DataFrame, mark: str) -> DataFrame:
    """The target with the newer rows appended."""
    return target.unionByName(newer_rows(target, source, mark))


def apply_changes(target: DataFrame, changes: DataFrame, key: str, order_by: str, operation: str = "operation") -> DataFrame:
    """The target after the latest change of every key; a DELETE drops the row."""
    latest = first_per_key(changes, key, F.col(order_by).desc())
    untouched = lookup_join(target, latest.select(key), key, "left_anti")
    kept = latest.where(F.col(operation) != "DELETE").select(*target.columns)
    return untouched.unionByName(kept)


def versions(df: DataFrame, key: str, valid_from: str) -> DataFrame:
    """History rows with ``valid_to`` (the key's next ``valid_from``) and ``is_current``.

    Where a key has very many versions the rows are indexed in (key, time) order and each is joined to
    its successor by position, which no key can skew.
    """
    if groups.hot_keys(df, [key], groups.RANKED_ROWS) is None:
        following = F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from))
        dated = df.withColumn("valid_to", following)
    else:
        indexed = global_index(df, [key, valid_from], "_at")
        after = indexed.select((F.col("_at") - 1).alias("_at"), F.col(key).alias("_key"), F.col(valid_from).alias("_next"))
        dated = (indexed.join(after, "_at", "left")
                 .withColumn("valid_to", F.when(F.col("_key").eqNullSafe(F.col(key)), F.col("_next")))
                 .drop("_at", "_key", "_next"))
    return dated.withColumn("is_current", F.col("valid_to").isNull())
