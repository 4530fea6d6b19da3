"""Noise detection: missing values, outliers, duplicates and formats; labels, report and cleaning.

A label is a row: the record's key, field, noise_type, severity, original_value, suggested_action.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowmill.functions.dates import shape_of
from rowmill.functions.numbers import numeric_fields
from rowmill.functions.text import PATTERNS, is_blank, matches
from rowmill.operators.filters import SAMPLE_FIELDS
from rowmill.operators.groups import MEDIAN_PICKS, order_statistics
from rowmill.operators.index import order_value
from rowmill.operators.profile import value_key
from rowmill.operators.scaling import long_numbers

# Action per noise type.
ACTIONS = {
    "missing_value": "impute or remove",
    "outlier": "investigate or cap",
    "inconsistent_format": "standardize",
    "duplicate": "deduplicate",
    "invalid_char": "sanitize or remove",
    "type_mismatch": "convert or coerce",
    "encoding_issue": "re-encode",
    "truncation": "expand field or truncate",
}
OTHER_ACTION = "review manually"
SEVERITY = {"missing_value": "medium", "outlier": "high", "duplicate": "high"}


def suggested_action(noise_type: str) -> str:
    return ACTIONS.get(noise_type, OTHER_ACTION)


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, empty or blank text, empty list."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c.isNull() | is_blank(c)
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


# ---- outliers -------------------------------------------------------------------------------------

_QUARTILES = {
    **MEDIAN_PICKS,
    "q1": lambda n: F.floor(n / 4),
    "q3": lambda n: F.floor(n * 3 / 4),
}


@dataclass(frozen=True)
class OutlierTest:
    """The test that applies to one field, with its statistics as plain numbers."""

    field: str
    method: str  # zscore, mad or iqr
    centre: float = 0.0
    scale: float = 1.0
    threshold: float = 0.0
    low: float = 0.0
    high: float = 0.0

    def flag(self) -> Column:
        v = F.col(self.field).cast("double")
        if self.method == "zscore":
            return F.abs((v - F.lit(self.centre)) / F.lit(self.scale)) > self.threshold
        if self.method == "mad":
            return F.lit(0.6745) * F.abs(v - F.lit(self.centre)) / F.lit(self.scale) > self.threshold
        return (v < self.low) | (v > self.high)


def _hits(df: DataFrame, tests: list[OutlierTest]) -> set[str]:
    if not tests:
        return set()
    row = df.agg(*[F.count_if(t.flag()).alias(f"h{i}") for i, t in enumerate(tests)]).first()
    return {t.field for i, t in enumerate(tests) if row[f"h{i}"] > 0}


def _positions(df: DataFrame, fields: list[str]) -> dict:
    rows = order_statistics(long_numbers(df, fields), ["field"], "value", _QUARTILES).collect()  # one per field
    return {row["field"]: row for row in rows}


def zscore_tests(df: DataFrame, fields: list[str], threshold: float = 3.0) -> list[OutlierTest]:
    """|z| above the threshold (1.5 for up to five numbers) with the sample deviation; needs three numbers."""
    if not fields:
        return []
    parts = []
    for i, f in enumerate(fields):
        v = F.col(f).cast("double")
        parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    row = df.agg(*parts).first()
    return [
        OutlierTest(f, "zscore", row[f"m{i}"], row[f"s{i}"], 1.5 if row[f"n{i}"] <= 5 else threshold)
        for i, f in enumerate(fields) if row[f"n{i}"] >= 3 and row[f"s{i}"] and row[f"s{i}"] > 0
    ]


def mad_tests(df: DataFrame, fields: list[str], positions: dict | None = None) -> list[OutlierTest]:
    """0.6745 |v - median| / MAD above 2.5; a field whose MAD is 0 has no test."""
    if not fields:
        return []
    positions = _positions(df, fields) if positions is None else positions
    middle = {f: (positions[f]["mid_low"] + positions[f]["mid_high"]) / 2
              for f in fields if f in positions and positions[f]["n"] >= 3}
    if not middle:
        return []
    apart = df.select(*[F.abs(F.col(f).cast("double") - F.lit(m)).alias(f) for f, m in middle.items()])
    spread = {r["field"]: (r["mid_low"] + r["mid_high"]) / 2 for r in
              order_statistics(long_numbers(apart, list(middle)), ["field"], "value", MEDIAN_PICKS).collect()}
    return [OutlierTest(f, "mad", m, spread[f], 2.5) for f, m in middle.items() if spread[f] > 0]


def iqr_tests(df: DataFrame, fields: list[str], positions: dict | None = None,
              allow_flat: bool = True) -> list[OutlierTest]:
    """Outside 1.5 interquartile ranges of the quartiles at sorted positions n//4 and 3n//4; needs four numbers."""
    if not fields:
        return []
    positions = _positions(df, fields) if positions is None else positions
    tests = []
    for f in fields:
        row = positions.get(f)
        if row is None or row["n"] < 4:
            continue
        wide = row["q3"] - row["q1"]
        if wide == 0 and not allow_flat:
            continue
        tests.append(OutlierTest(f, "iqr", low=row["q1"] - 1.5 * wide, high=row["q3"] + 1.5 * wide))
    return tests


def outlier_tests(df: DataFrame, fields: list[str] | None = None, threshold: float = 3.0) -> list[OutlierTest]:
    """Per numeric field the first of z-score, MAD and IQR that finds anything.

    What comes to the driver is one row of statistics per field and method.
    """
    numeric = numeric_fields(df)
    fields = [f for f in (fields or numeric) if f in numeric]
    chosen = {}
    tests = zscore_tests(df, fields, threshold)
    found = _hits(df, tests)
    chosen.update({t.field: t for t in tests if t.field in found})
    rest = [f for f in fields if f not in chosen]
    if rest:
        positions = _positions(df, rest)
        rest = [f for f in rest if f in positions and positions[f]["n"] >= 3]
        tests = mad_tests(df, rest, positions)
        found = _hits(df, tests)
        chosen.update({t.field: t for t in tests if t.field in found})
        rest = [f for f in rest if f not in chosen]
        chosen.update({t.field: t for t in iqr_tests(df, rest, positions, allow_flat=False)})
    return [chosen[f] for f in fields if f in chosen]


# ---- duplicates -----------------------------------------------------------------------------------

def _unpacked(order: list[str]) -> list[Column]:
    return [F.col("_first").alias(order[0])] if len(order) == 1 else [F.col(f"_first.{c}").alias(c) for c in order]


def key_duplicates(df: DataFrame, key_fields: list[str] | None, order_by) -> DataFrame:
    """Second and later records with equal key fields (all fields when none are given).

    The first of each key is found by a pre-aggregated minimum; the others are the rows whose unique
    order key is not among those, so nothing is shuffled by a value that may be frequent.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if key_fields:
        keys = [F.col(name).alias(f"_k{i}") for i, name in enumerate(key_fields)]
    else:
        whole = F.to_json(F.struct(*[_text(df, name).alias(name) for name in df.columns if name not in order]))
        keys = [F.sha2(whole, 256).alias("_k0")]
    firsts = (
        df.select(*keys, *order)
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min(order_value(order)).alias("_first"))
        .select(*_unpacked(order))
    )
    return df.join(firsts, order, "left_anti")


def exact_duplicates(df: DataFrame, order_by) -> DataFrame:
    """Second and later records that equal an earlier one in all fields but the order key."""
    return key_duplicates(df, None, order_by)


def _long_values(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(f).alias("field"), _text(df, f).alias("value"), is_missing(df, f).alias("missing"))
               for f in fields]
    return df.select(*order, F.explode(F.array(*entries)).alias("_x")).select(*order, "_x.*")


def field_duplicates(df: DataFrame, fields: list[str], order_by) -> DataFrame:
    """Per field the second and later occurrences of each non-null value: order key, field, value."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    values = _long_values(df, fields, order).where(F.col("value").isNotNull()).drop("missing")
    firsts = (values.groupBy("field", value_key(F.col("value")).alias("key")).agg(F.min(order_value(order)).alias("_first"))
              .select("field", *_unpacked(order)))
    return values.join(firsts, [*order, "field"], "left_anti").select(*order, "field", "value")


# ---- formats --------------------------------------------------------------------------------------

def value_formats(df: DataFrame, field: str, kind: str = "date") -> DataFrame:
    """The records with a value, and the name of its date or phone shape as ``format``."""
    return df.withColumn("format", shape_of(F.col(field), kind)).where(F.col("format").isNotNull())


def date_inconsistencies(df: DataFrame, field: str, order_by) -> DataFrame:
    """Records whose date has no known shape, if the column has more than one shape."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    shaped = value_formats(df, field)
    several = shaped.agg((F.count_distinct("format") > 1).alias("several")).scalar()
    return shaped.where((F.col("format") == "unknown") & several).select(
        *order, F.lit(field).alias("field"), F.col(field).cast("string").alias("value"),
        F.lit("unknown").alias("detected_format"), F.lit("format_inconsistent").alias("noise_type"))


# ---- labels, report, cleaning ---------------------------------------------------------------------

def _label(order: list[str], noise_type: str, value: str = "value") -> list[Column]:
    return [*[F.col(c) for c in order], F.col("field"), F.lit(noise_type).alias("noise_type"),
            F.lit(SEVERITY.get(noise_type, "low")).alias("severity"), F.col(value).alias("original_value"),
            F.lit(suggested_action(noise_type)).alias("suggested_action")]


def noise_labels(df: DataFrame, order_by, field: str | None = None) -> DataFrame:
    """Missing (medium), outlier (high) and duplicate (high) labels of one field or of all fields."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    fields = [field] if field else sorted(c for c in df.columns if c not in SAMPLE_FIELDS)
    missing = _long_values(df, fields, order).where("missing").select(*_label(order, "missing_value"))
    labels = [missing]
    tests = outlier_tests(df, fields)
    if tests:
        entries = [F.when(F.coalesce(t.flag(), F.lit(False)), F.struct(
            F.lit(t.field).alias("field"), F.col(t.field).cast("string").alias("value"))) for t in tests]
        flagged = df.select(*order, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_x"))
        labels.append(flagged.select(*order, "_x.*").select(*_label(order, "outlier")))
    labels.append(field_duplicates(df, fields, order).select(*_label(order, "duplicate")))
    return reduce(DataFrame.unionByName, labels)


def field_label(field: str, noise_type: str, confidence: float, spark) -> DataFrame:
    """One label for a whole field."""
    return spark.createDataFrame([(field, noise_type, float(confidence), "all")],
                                 "field string, noise_type string, confidence double, affected_records string")


def counts_by_type(labels: DataFrame) -> DataFrame:
    return labels.groupBy("noise_type").agg(
        F.count(F.lit(1)).alias("label_count"), F.array_sort(F.collect_set("field")).alias("fields"))


def counts_by_field(labels: DataFrame) -> DataFrame:
    return labels.groupBy("field").agg(F.count(F.lit(1)).alias("label_count"))


def noise_report(df: DataFrame, labels: DataFrame, order_by) -> DataFrame:
    """One row: records, labels, labels per record, records with a label and their share."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    per_record = labels.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    labelled = per_record.agg(F.struct(F.coalesce(F.sum("_n"), F.lit(0)).alias("labels"),
                                       F.count(F.lit(1)).alias("records")).alias("x")).scalar()
    total = F.col("total_records")
    share = lambda n: F.when(total > 0, n / total).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        "total_records", labelled["labels"].alias("label_count"), share(labelled["labels"]).alias("label_rate"),
        labelled["records"].alias("noisy_records"), share(labelled["records"]).alias("noisy_rate"))


def clean(df: DataFrame, labels: DataFrame, order_by, remove_labeled: bool = True) -> DataFrame:
    """Drop every record that has a label."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not remove_labeled:
        return df
    return df.join(labels.select(*order).distinct(), order, "left_anti")


# ---- further rules --------------------------------------------------------------------------------

EMAIL = dict(PATTERNS)["email"]


def future_date(name: str, now: Column | None = None) -> Column:
    return F.col(name).cast("timestamp") > (F.current_timestamp() if now is None else now)


def negative_number(name: str) -> Column:
    return F.col(name) < 0


def invalid_email(name: str) -> Column:
    return F.col(name).isNotNull() & ~matches(F.col(name), EMAIL)


def invalid_characters(name: str) -> Column:
    """Control characters other than tab and line ends."""
    return F.col(name).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def encoding_issue(name: str) -> Column:
    """A replacement character, or UTF-8 bytes that were read as Latin-1."""
    return F.col(name).rlike("�|[ÂÃ][\u0080-¿]")


def type_mismatch(name: str, expected: str) -> Column:
    """Text that does not read as the expected SQL type."""
    return F.col(name).isNotNull() & F.col(name).try_cast(expected).isNull()


def phone_mismatch(name: str) -> Column:
    return shape_of(F.col(name), "phone") == "unknown"


_RULE_SEVERITY = {"future_date": "high", "negative_number": "high", "invalid_email": "medium",
                  "phone_format_inconsistent": "low"}


def rule_labels(df: DataFrame, order_by, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Labels from (field, noise_type, condition) rules, in one pass over the records."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    entries = [F.when(F.coalesce(condition, F.lit(False)), F.struct(
        F.lit(name).alias("field"), F.lit(kind).alias("noise_type"),
        F.lit(_RULE_SEVERITY.get(kind, "low")).alias("severity"), _text(df, name).alias("original_value"),
        F.lit(suggested_action(kind)).alias("suggested_action"))) for name, kind, condition in rules]
    found = df.select(*order, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_x"))
    return found.select(*order, "_x.*")
