"""Rules that add one field each; later rules see the fields of earlier ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.functions.dates import date_part
from rowmill.functions.numbers import with_expression
from rowmill.operators.joins import lookup_field


@dataclass(frozen=True)
class Rule:
    """Base of every enrichment rule: ``apply`` adds ``target``. Subclass it for a rule of your own."""

    target: str

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Calculate(Rule):
    """A SQL expression; numeric text is read as numbers first."""

    expression: str

    def apply(self, df: DataFrame) -> DataFrame:
        return with_expression(df, self.target, self.expression)


@dataclass(frozen=True)
class Lookup(Rule):
    """One field of the row of ``source`` whose key equals the record's ``key_field``."""

    source: DataFrame
    key_field: str
    source_key: str | None = None
    source_field: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        return lookup_field(df, self.target, self.source, self.key_field, self.source_key, self.source_field)


@dataclass(frozen=True)
class DatePart(Rule):
    source: str
    part: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, date_part(F.col(self.source), dict(df.dtypes)[self.source], self.part))


@dataclass(frozen=True)
class CategoryMap(Rule):
    """Label of the first inclusive range that holds the value; values from the last high on get the last label."""

    source: str
    ranges: list
    labels: list

    def apply(self, df: DataFrame) -> DataFrame:
        value = F.col(self.source)
        chosen = F.when(value >= self.ranges[-1][1], F.lit(self.labels[-1]))
        for (low, high), label in reversed(list(zip(self.ranges, self.labels))):
            chosen = F.when(value.between(low, high), F.lit(label)).otherwise(chosen)
        return df.withColumn(self.target, chosen)


@dataclass(frozen=True)
class Conditional(Rule):
    """``true_value`` where the condition holds, else (also where it is null or raises) ``false_value``."""

    condition: str
    true_value: Any
    false_value: Any = None

    def apply(self, df: DataFrame) -> DataFrame:
        choose = lambda c: F.when(c.cast("boolean"), F.lit(self.true_value)).otherwise(F.lit(self.false_value))
        return with_expression(df, self.target, self.condition, choose, safe=True)


@dataclass(frozen=True)
class Derive(Rule):
    """A user function: it gets the DataFrame's columns by name and returns a Column (a pandas UDF call too)."""

    func: Callable[[dict[str, Column]], Column] = field(default=None)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, self.func({name: F.col(name) for name in df.columns}))


def enrich(df: DataFrame, rules: list[Rule]) -> DataFrame:
    for rule in rules:
        df = rule.apply(df)
    return df


def rules_from_config(config: list[dict], lookups: dict[str, DataFrame] | None = None) -> list[Rule]:
    """Rules from dictionaries with ``type`` calculate, lookup, date_extract, category_map, conditional or derive.

    A lookup's ``source`` is a DataFrame or a name in ``lookups``. Other types are skipped.
    """
    lookups = lookups or {}

    def lookup(c: dict) -> Rule:
        source = lookups[c["source"]] if isinstance(c["source"], str) else c["source"]
        value = (c.get("value_fields") or [c["target"]])[0]
        return Lookup(c["target"], source, c["key_field"], c.get("source_key"), c.get("source_field") or value)

    makers = {
        "calculate": lambda c: Calculate(c["target"], c["expression"]),
        "lookup": lookup,
        "date_extract": lambda c: DatePart(c["target"], c["source"], c["part"]),
        "category_map": lambda c: CategoryMap(c["target"], c["source"], c["ranges"], c["labels"]),
        "conditional": lambda c: Conditional(c["target"], c["condition"], c["true_value"], c.get("false_value")),
        "derive": lambda c: Derive(c["target"], c["func"]),
    }
    return [makers[c["type"]](c) for c in config if c.get("type") in makers]
