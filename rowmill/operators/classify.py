"""Classification of JSON records by their key sets, and unification of mixed ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.functions.dates import standard_date
from rowmill.functions.numbers import DIGITS
from rowmill.operators.index import order_value

COMMON_SHARE = 0.3  # fixed value: below this share of common keys a data set is ambiguous


def variants(df: DataFrame, json: str, order_by) -> DataFrame:
    """Distinct key sets with their record counts: fields (sorted, null if no object), count, first_seen."""
    keys = F.array_sort(F.json_object_keys(json))
    return df.groupBy(keys.alias("fields")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order_value(order_by)).alias("first_seen"))


def variant_counts(df: DataFrame, json: str, order_by, limit: int | None = None) -> DataFrame:
    """Key sets, most common first; of equally common ones the first seen."""
    found = variants(df, json, order_by).orderBy(F.desc("count"), "first_seen")
    found = found if limit is None else found.limit(limit)
    return found.select("fields", "count")


def classification(found: DataFrame) -> DataFrame:
    """One row from the table of variants: category, confidence, record and variant counts."""
    totals = found.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("variants"),
        F.coalesce(F.sum(F.when(F.col("fields").isNull(), F.col("count"))), F.lit(0)).alias("others"),
        F.max("count").alias("largest"),
    )
    per_key = found.select(F.explode("fields").alias("key"), "count").groupBy("key").agg(F.sum("count").alias("n"))
    records = found.agg(F.sum("count").alias("records")).select("records").scalar()
    shared = per_key.agg(F.struct(F.count(F.lit(1)).alias("all"),
                                  F.count_if(F.col("n") == records).alias("common")).alias("k")).scalar()
    reconcilable = (shared["common"] > 0) & (shared["common"] / shared["all"] >= COMMON_SHARE)
    category = (
        F.when((F.col("records") == 0) | (F.col("others") > 0), "ambiguous")
        .when(F.col("variants") == 1, "certain")
        .when(reconcilable, "mixed").otherwise("ambiguous")
    )
    share = F.least(F.lit(0.9), F.greatest(F.lit(0.5), F.col("largest") / F.col("records")))
    confidence = F.when(F.col("category") == "certain", 1.0).when(F.col("category") == "ambiguous", 0.3).otherwise(share)
    return totals.withColumn("category", category).select(
        "category", confidence.alias("confidence"), "records", "variants",
        shared["common"].alias("common_keys"), shared["all"].alias("all_keys"))


def category(df: DataFrame, json: str, order_by) -> DataFrame:
    return classification(variants(df, json, order_by))


def dominant_fields(df: DataFrame, json: str, order_by) -> list[str]:
    """The key names of the most common key set (one row comes to the driver)."""
    top = variants(df.where(F.col(json).isNotNull()), json, order_by).orderBy(F.desc("count"), "first_seen").first()
    return list(top["fields"] or []) if top else []


def _path(name: str) -> str:
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return f'$["{quoted}"]'


def unify_dominant(df: DataFrame, json: str, order_by, keep: list[str] | None = None) -> DataFrame:
    """One text column per dominant key: extra keys are dropped, missing ones are null.

    ``keep`` names columns to carry along; a dominant key of the same name replaces one.
    """
    fields = dominant_fields(df, json, order_by)
    parsed = df.withColumn("_v", F.try_parse_json(json))
    kept = [c for c in keep or [] if c not in fields]
    return parsed.select(*kept, *[F.try_variant_get("_v", _path(f), "string").alias(f) for f in fields])


def unify_types(df: DataFrame, fields: list[str]) -> DataFrame:
    """Text columns to numbers: all digits to integers, digits and decimals to doubles, others unchanged."""
    digits = lambda c: c.rlike(DIGITS) & c.try_cast("bigint").isNotNull()
    decimal = lambda c: c.contains(".") & c.try_cast("double").isNotNull()
    row = df.agg(*[F.struct(
        F.count(f).alias("n"),
        F.bool_and(F.when(F.col(f).isNotNull(), digits(F.col(f)))).alias("whole"),
        F.bool_and(F.when(F.col(f).isNotNull(), digits(F.col(f)) | decimal(F.col(f)))).alias("number"),
    ).alias(f"t{i}") for i, f in enumerate(fields)]).first()
    casts = {}
    for i, f in enumerate(fields):
        seen = row[f"t{i}"]
        if seen["n"] and seen["whole"]:
            casts[f] = F.col(f).cast("bigint")
        elif seen["n"] and seen["number"]:
            casts[f] = F.col(f).cast("double")
    return df.withColumns(casts) if casts else df


def merge_fields(df: DataFrame, target: str, sources: list[str]) -> DataFrame:
    """The first present of several optional fields."""
    return df.withColumn(target, F.coalesce(*[F.col(s) for s in sources])).drop(*[s for s in sources if s != target])


def unify_dates(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: standard_date(F.col(f)) for f in fields})


@dataclass
class Routed:
    status: str
    category: str
    data: DataFrame | None
    reason: str | None = None


def route(df: DataFrame, json: str, order_by) -> Routed:
    """Certain data passes, mixed data is unified, ambiguous data is rejected."""
    kind = category(df, json, order_by).first()["category"]
    if kind == "certain":
        return Routed("success", kind, df)
    if kind == "mixed":
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        unified = unify_dominant(df, json, order_by, keep=order)
        return Routed("success", kind, unify_types(unified, [c for c, t in unified.dtypes if t == "string"]))
    return Routed("rejected", kind, None, "Data structure is incompatible")
