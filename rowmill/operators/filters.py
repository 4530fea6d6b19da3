"""Row filters and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowmill.functions.conditions import safe_condition
from rowmill.functions.numbers import text_numbers, with_expression

SAMPLE_FIELDS = ("_sample_index", "_sample_strategy")


def filter_rows(df: DataFrame, condition: str | None) -> DataFrame:
    """Rows where the condition is true; a null result or an error drops the row. No condition keeps all."""
    if not condition:
        return df
    if not text_numbers(condition, df):
        return df.where(F.expr(safe_condition(condition, df)).cast("boolean"))  # plain, so that it reaches the scan
    return with_expression(df, "_keep", condition, lambda c: c.cast("boolean"), safe=True).where("_keep").drop("_keep")


def equals_all(query: dict | None):
    """AND of ``field = value``; an empty query matches every row."""
    terms = [F.col(name) == F.lit(value) for name, value in (query or {}).items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def drop_sample_fields(df: DataFrame) -> DataFrame:
    return df.drop(*SAMPLE_FIELDS)


def truncate_text(df: DataFrame, field: str, length: int = 1500) -> DataFrame:
    return df.withColumn(field, F.substring(field, 1, length))


def has_records(df: DataFrame) -> bool:
    """Whether there is at least one record; that each is a record follows from the schema."""
    return not df.isEmpty()
