"""The normalized envelope: records as (_id, _source[, _raw]) and one row of metadata."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rowmill.functions.names import data_category, normalize_names, schema_hash
from rowmill.operators.index import as_columns, global_index
from rowmill.operators.setops import union_by_name

METADATA = ("source_type string, source_channel string, source_path string, record_count long, "
            "columns array<string>, parsed_at timestamp, schema_hash string, data_category string")


@dataclass
class Envelope:
    records: DataFrame
    metadata: DataFrame
    columns: list[str]


def _metadata(df: DataFrame, columns: list[str], kind: str, source_type: str, channel: str, path: str | None) -> DataFrame:
    count = F.count(F.lit(1))
    return df.agg(count.alias("record_count")).select(
        F.lit(source_type).alias("source_type"), F.lit(channel).alias("source_channel"),
        F.lit(path).cast("string").alias("source_path"), "record_count",
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        F.current_timestamp().alias("parsed_at"), F.lit(schema_hash(columns)).alias("schema_hash"),
        F.lit(kind).alias("data_category"))


def envelope(df: DataFrame, order_by, source_type: str, channel: str = "file", path: str | None = None,
             generate_ids: bool = True, include_raw: bool = False) -> Envelope:
    """``_id`` is the md5 prefix of the path and the record's position, or the position alone."""
    prefix = hashlib.md5((path or "").encode()).hexdigest()[:8] + "_" if generate_ids else ""
    indexed = global_index(df, order_by, "_position")
    named = normalize_names(df)
    source = F.struct(*[c.alias(n) for c, n in _normalized_columns(df)])
    columns = [F.concat(F.lit(prefix), F.col("_position").cast("string")).alias("_id"), source.alias("_source")]
    if include_raw:
        columns.append(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_raw"))
    return Envelope(indexed.select(*columns),
                    _metadata(df, df.columns, data_category(df.schema), source_type, channel, path), named.columns)


def _normalized_columns(df: DataFrame):
    from rowmill.functions.names import _renamed, snake_key

    merged = {}
    for f in df.schema.fields:
        merged[snake_key(f.name)] = _renamed(F.col(f"`{f.name}`"), f.dataType, snake_key)
    return [(value, name) for name, value in merged.items()]


def denormalize(records: DataFrame) -> DataFrame:
    return records.select("_source.*")


def merge(envelopes: list[Envelope]) -> Envelope:
    """All records of all envelopes, duplicates kept; columns are the sorted union."""
    flat = [e.records.select("_id", "_source.*") for e in envelopes]
    merged = union_by_name(flat)
    fields = [c for c in merged.columns if c != "_id"]
    records = merged.select("_id", F.struct(*fields).alias("_source"))
    columns = sorted({c for e in envelopes for c in e.columns})
    return Envelope(records, _metadata(records, columns, "flatten", "merged", "multiple", None), columns)


def export(item: Envelope, path: str) -> None:
    """Records as JSON lines and the metadata row next to them."""
    item.records.write.json(f"{path}/records")
    item.metadata.write.json(f"{path}/metadata")


def unwrap_records(documents: DataFrame) -> DataFrame:
    """Records of an exported envelope, or of a document that holds them in ``records``."""
    if "records" in documents.columns:
        documents = documents.select(F.explode("records").alias("_r")).select("_r.*")
    return denormalize(documents) if "_source" in documents.columns else documents
