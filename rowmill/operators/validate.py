"""Validation rules as violation columns; every (record, failing rule) is one error."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmill.functions.text import matches
from rowmill.operators.joins import is_in

ERROR = "array<struct<field:string,rule:string,message:string>>"

# Type names as they appear in messages.
_TYPE_NAMES = [
    (T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "float"), (T.StringType, "str"),
    (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DateType, "date"),
    (T.ArrayType, "list"), (T.StructType, "dict"), (T.MapType, "dict"), (T.BinaryType, "bytes"),
]


def type_name(kind: T.DataType) -> str:
    return next((name for cls, name in _TYPE_NAMES if isinstance(kind, cls)), kind.simpleString())


@dataclass(frozen=True)
class Check:
    """Base of every rule: ``failure`` is the message where the record violates it, else null."""

    field: str

    @property
    def name(self) -> str:
        return f"{type(self).__name__.lower()}_{self.field}"

    def failure(self, df: DataFrame) -> Column:
        raise NotImplementedError


def _if_present(df: DataFrame, name: str, build: Callable[[Column], Column]) -> Column:
    return build(F.col(name)) if name in df.columns else F.lit(None).cast("string")


@dataclass(frozen=True)
class Required(Check):
    def failure(self, df: DataFrame) -> Column:
        if self.field not in df.columns:
            return F.lit(f"Missing required field: {self.field}")
        empty = F.col(self.field).isNull()
        if isinstance(df.schema[self.field].dataType, T.StringType):
            empty = empty | (F.col(self.field) == "")
        return F.when(empty, F.lit(f"Field cannot be empty: {self.field}"))


@dataclass(frozen=True)
class Type(Check):
    """The field has type ``expected`` (int, float, str, bool, list, dict, datetime).

    A typed column passes or fails as a whole; a bool counts as int. With ``parse_text`` a text column
    passes where its text reads as the type.
    """

    expected: Any
    parse_text: bool = True

    def failure(self, df: DataFrame) -> Column:
        expected = self.expected if isinstance(self.expected, str) else self.expected.__name__

        def build(c: Column) -> Column:
            actual = type_name(df.schema[self.field].dataType)
            message = F.lit(f"Field {self.field} must be {expected}, got {actual}")
            if actual == expected or (actual, expected) == ("bool", "int"):
                return F.lit(None).cast("string")
            casts = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}
            if actual == "str" and self.parse_text and expected in casts:
                return F.when(c.isNotNull() & c.try_cast(casts[expected]).isNull(), message)
            return F.when(c.isNotNull(), message)

        return _if_present(df, self.field, build)


@dataclass(frozen=True)
class Range(Check):
    """Inclusive bounds; text that is no number passes."""

    min: float | None = None
    max: float | None = None

    def failure(self, df: DataFrame) -> Column:
        def build(c: Column) -> Column:
            number = c.try_cast("double")
            message = F.lit(None).cast("string")
            if self.max is not None:
                message = F.when(number > self.max, F.lit(f"{self.field} above maximum: {self.max}"))
            if self.min is not None:
                message = F.when(number < self.min, F.lit(f"{self.field} below minimum: {self.min}")).otherwise(message)
            return message

        return _if_present(df, self.field, build)


@dataclass(frozen=True)
class Pattern(Check):
    """The text starts with a match of ``pattern``."""

    pattern: str = ""

    def failure(self, df: DataFrame) -> Column:
        return _if_present(df, self.field, lambda c: F.when(
            ~matches(c.cast("string"), f"^(?:{self.pattern})"), F.lit(f"{self.field} does not match pattern")))


@dataclass(frozen=True)
class Enum(Check):
    allowed: tuple = ()

    def failure(self, df: DataFrame) -> Column:
        return _if_present(df, self.field, lambda c: F.when(
            ~c.isin(*self.allowed), F.lit(f"{self.field} must be one of {list(self.allowed)}")))


@dataclass(frozen=True)
class Custom(Check):
    """``validator`` takes the field's Column and returns a boolean one (a pandas UDF call too)."""

    validator: Callable[[Column], Column] = None
    message: str = "Custom validation failed"

    def failure(self, df: DataFrame) -> Column:
        return _if_present(df, self.field, lambda c: F.when(
            c.isNotNull() & ~F.coalesce(self.validator(c), F.lit(False)), F.lit(self.message)))


@dataclass(frozen=True)
class CrossField(Check):
    """A predicate over several fields; a null among them, or a null result, passes."""

    fields: tuple = ()
    validator: Callable[..., Column] = None
    message: str = "Cross-field validation failed"
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or f"crossfield_{self.field}"

    def failure(self, df: DataFrame) -> Column:
        if not self.fields or any(f not in df.columns for f in self.fields):
            return F.lit(None).cast("string")
        columns = [F.col(f) for f in self.fields]
        present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
        return F.when(present & ~F.coalesce(self.validator(*columns), F.lit(True)), F.lit(self.message))


@dataclass(frozen=True)
class Unique(Check):
    """No value occurs twice. It looks at all records, so :func:`with_errors` handles it with a join."""

    def failure(self, df: DataFrame) -> Column:
        return F.when(F.col(f"_dup_{self.field}"), F.lit(f"{self.field} is not unique"))


def duplicated_rows(df: DataFrame, field: str) -> DataFrame:
    """Rows whose non-null value occurs more than once."""
    repeated = df.where(F.col(field).isNotNull()).groupBy(field).count().where("count > 1")
    return is_in(df, repeated, field)


def _mark_duplicates(df: DataFrame, field: str) -> DataFrame:
    from rowmill.operators.joins import lookup_join

    repeated = (df.where(F.col(field).isNotNull()).groupBy(field).count().where("count > 1")
                .select(field, F.lit(True).alias(f"_dup_{field}")))
    return lookup_join(df, repeated, field, "left").fillna(False, [f"_dup_{field}"])


def with_errors(df: DataFrame, rules: list[Check], name: str = "errors") -> DataFrame:
    """Add the array of the record's errors, in rule order."""
    columns = df.columns
    for rule in rules:
        if isinstance(rule, Unique) and rule.field in columns:
            df = _mark_duplicates(df, rule.field)
    present = [r for r in rules if not isinstance(r, Unique) or r.field in columns]
    if not present:
        return df.select(*columns, F.array().cast(ERROR).alias(name))
    entries = []
    for rule in present:
        message = rule.failure(df)
        entries.append(F.when(message.isNotNull(), F.struct(
            F.lit(rule.field).alias("field"), F.lit(rule.name).alias("rule"), message.alias("message"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.select(*columns, found.alias(name))


def error_rows(df: DataFrame, rules: list[Check], keep: list[str] | None = None) -> DataFrame:
    """One row per error: the kept fields of the record, then field, rule and message."""
    keep = df.columns if keep is None else keep
    checked = with_errors(df, rules, "_errors").where(F.size("_errors") > 0)
    return checked.select(*keep, F.explode("_errors").alias("_e")).select(*keep, "_e.*")


def summarize(checked: DataFrame, name: str = "errors") -> DataFrame:
    """One row: valid, error_count, warning_count. No rule produces warnings."""
    total = F.coalesce(F.sum(F.size(name)), F.lit(0)).cast("long")
    return checked.agg(total.alias("error_count")).select(
        (F.col("error_count") == 0).alias("valid"), "error_count", F.lit(0).cast("long").alias("warning_count"))


def validate(df: DataFrame, rules: list[Check]) -> DataFrame:
    return summarize(with_errors(df, rules))


def without_rule(rules: list[Check], name: str) -> list[Check]:
    return [rule for rule in rules if rule.name != name]


def checks_from_config(config: list[dict]) -> list[Check]:
    """Rules from dictionaries with ``type`` required, type, range, pattern, enum, unique, custom or cross_field."""
    makers = {
        "required": lambda c: Required(c["field"]),
        "type": lambda c: Type(c["field"], c["expected_type"]),
        "range": lambda c: Range(c["field"], c.get("min"), c.get("max")),
        "pattern": lambda c: Pattern(c["field"], c["pattern"]),
        "enum": lambda c: Enum(c["field"], tuple(c["allowed_values"])),
        "unique": lambda c: Unique(c["field"]),
        "custom": lambda c: Custom(c["field"], c["validator"], c.get("error_msg") or "Custom validation failed"),
        "cross_field": lambda c: CrossField(c["fields"][0], tuple(c["fields"]), c["validator"],
                                            c.get("error_msg") or "Cross-field validation failed", c.get("name")),
    }
    return [makers[c["type"]](c) for c in config if c.get("type") in makers]
