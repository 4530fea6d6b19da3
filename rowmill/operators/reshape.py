"""Pivot, melt, nest and flatten."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rowmill.operators.encoding import MAX_CATEGORIES, categories
from rowmill.operators.groups import GROUP_ROWS, collect_parts
from rowmill.operators.index import order_value


def pivot_long(df: DataFrame, index: str, columns: str, values: str, order_by) -> DataFrame:
    """The last value of every (index, column) pair as rows: the form for any number of columns."""
    return df.groupBy(index, columns).agg(F.max_by(values, order_value(order_by)).alias(values))


def pivot(df: DataFrame, index: str, columns: str, values: str, order_by,
          column_values: list[str] | None = None) -> DataFrame:
    """One row per ``index``, one column per value of ``columns``; the last record of a cell wins.

    A null column value becomes the column ``null``. Pairs are reduced before rows are built.
    """
    named = df.withColumn(columns, F.coalesce(F.col(columns).cast("string"), F.lit("null")))
    if column_values is None:
        column_values = categories(named, columns)
        if column_values is None:
            raise ValueError(f"{columns} has over {MAX_CATEGORIES} values: use pivot_long for the same in rows")
    last = F.max_by(values, order_value(order_by))
    return named.groupBy(index).pivot(columns, column_values).agg(last)


def melt(df: DataFrame, id_vars: list[str], value_vars: list[str]) -> DataFrame:
    """One row (ids, variable, value) per record and value field; mixed types become text."""
    ids = [c for c in id_vars if c in df.columns]
    fields = [c for c in value_vars if c in df.columns]
    kinds = {dict(df.dtypes)[c] for c in fields}
    if len(kinds) > 1:
        numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in fields)
        common = "double" if numeric else "string"
        df = df.select(*ids, *[F.col(c).cast(common).alias(c) for c in fields])
    return df.unpivot(ids, fields, "variable", "value")


def nest(df: DataFrame, group_by: str, nest_fields: list[str], order_by,
         max_items: int = GROUP_ROWS) -> DataFrame:
    """``key`` and its records' fields as ``items`` in order; large groups continue in further ``part`` rows."""
    fields = {name: F.col(name) for name in nest_fields if name in df.columns}
    return collect_parts(df.withColumnRenamed(group_by, "key") if group_by not in fields
                         else df.withColumn("key", F.col(group_by)),
                         ["key"], order_by, fields, max_items)


def flatten(df: DataFrame) -> DataFrame:
    """Arrays become rows, parent fields repeat, nested keys are joined with ``_``; empty arrays keep the row."""
    while True:
        nested = next((f for f in df.schema.fields
                       if isinstance(f.dataType, (T.StructType, T.ArrayType))), None)
        if nested is None:
            return df
        columns = []
        for f in df.schema.fields:
            if f.name != nested.name:
                columns.append(F.col(f"`{f.name}`"))
            elif isinstance(nested.dataType, T.ArrayType):
                columns.append(F.explode_outer(f"`{f.name}`").alias(f.name))
            else:
                columns += [F.col(f"`{f.name}`").getField(child.name).alias(f"{f.name}_{child.name}")
                            for child in nested.dataType.fields]
        df = df.select(*columns)
