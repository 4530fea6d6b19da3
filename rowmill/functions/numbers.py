"""Numbers held as text, and expression strings over such fields."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmill.functions.conditions import safe_condition

INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
NUMBER_TEXT = (r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?"
               r"|inf|infinity|nan)\s*$")
DIGITS = r"^[0-9]+$"


def is_integer_text(c: Column) -> Column:
    """Optional sign, digits with single underscores between them, blanks around."""
    return c.rlike(INTEGER_TEXT)


def is_number_text(c: Column) -> Column:
    """Integer, decimal or exponent form, infinity or nan. A pattern, as a failing cast costs much more."""
    return c.rlike(NUMBER_TEXT)


def to_number(c: Column) -> Column:
    return F.when(is_number_text(c), F.regexp_replace(F.trim(c), "_", "").try_cast("double"))


def number_or_null(c: Column) -> Column:
    """Integer text or text with a point that reads as a number; other text, ``1e3`` too, gives null."""
    return F.when(is_integer_text(c) | c.contains("."), to_number(c))


def expression_names(expression: str, columns: list[str]) -> list[str]:
    """The columns an expression names outside of quoted text, in table order."""
    bare = re.sub(r"'[^']*'", " ", expression)
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", bare))
    return [name for name in columns if name in words]


def _uses(node, parent: str = ""):
    """Each column below an analyzed expression with how it is used: as a number, for a null test, or otherwise."""
    kind = node.getClass().getSimpleName()
    if kind == "AttributeReference":
        yield node.name(), "null test" if parent in ("IsNull", "IsNotNull") else parent
        return
    if kind == "Cast" and isinstance(T._parse_datatype_json_string(node.dataType().json()), T.NumericType):
        kind = "number"
    children = node.children()
    for i in range(children.size()):
        yield from _uses(children.apply(i), kind)


def text_numbers(expression: str, df: DataFrame) -> list[str]:
    """Text columns that the expression uses as numbers: those that the analyzer casts to a number and that have no
    other use but null tests. Where text alone does not fit the types, all text columns that it names."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    named = [n for n in expression_names(expression, df.columns) if n in text]
    if not named:
        return []
    try:
        outputs = df.select(F.expr(expression))._jdf.queryExecution().analyzed().expressions()
    except AnalysisException:
        return named
    uses: dict[str, set] = {}
    for i in range(outputs.size()):
        for name, use in _uses(outputs.apply(i)):
            uses.setdefault(name, set()).add(use)
    return [n for n in named if "number" in uses.get(n, ()) and uses[n] <= {"number", "null test"}]


def with_expression(df: DataFrame, target: str, expression: str, wrap=lambda c: c, safe: bool = False) -> DataFrame:
    """Add ``target`` from a SQL expression; text fields used as numbers are read as numbers first.

    ``safe``: where evaluating it raises, the value of the expression is null.
    """
    text = text_numbers(expression, df)
    written = lambda rows: wrap(F.expr(safe_condition(expression, rows) if safe else expression)).alias(target)
    rest = [n for n in df.columns if n != target]
    if not text:
        return df.select(*rest, written(df))
    staged = df.select(*[F.col(n).alias(f"_keep_{n}") for n in text],
                       *[number_or_null(F.col(n)).alias(n) if n in text else F.col(n) for n in df.columns])
    back = [F.col(f"_keep_{n}").alias(n) if n in text else F.col(n) for n in rest]
    return staged.select(*back, written(staged))


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
