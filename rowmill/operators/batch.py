"""A chain of Python actions per item; an error becomes a value of that item."""

from __future__ import annotations

from typing import Any, Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


def run_actions(df: DataFrame, item: str, actions: list[Callable[[Any], Any]], output_type: str = "string") -> DataFrame:
    """Add output, error and processed: each item goes through the actions, each taking the last result.

    Partitions run side by side and Arrow batches carry the rows; the other columns are kept. Actions get Python
    values of the item's type, None for a null; a result that is not of ``output_type`` is an error of its item.
    """
    added = T._parse_datatype_string(f"output {output_type}, error string, processed boolean").fields
    schema = T.StructType([*df.schema.fields, *added])
    place, kind = df.columns.index(item), to_arrow_type(added[0].dataType)

    def one(value):
        try:
            for action in actions:
                value = action(value)
            return pa.scalar(value, kind).as_py(), None
        except Exception as problem:
            return None, str(problem)

    def run(batches):
        for batch in batches:
            results = [one(value) for value in batch.column(place).to_pylist()]
            columns = [pa.array([r[0] for r in results], kind), pa.array([r[1] for r in results], pa.string()),
                       pa.array([True] * len(results))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def errors(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull())


def tally(results: DataFrame) -> DataFrame:
    """One row: items, success_count, error_count."""
    return results.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("processed") & F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"))
