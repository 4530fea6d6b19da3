"""Message and telemetry streams, and the row-wise operators on a stream."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowmill.operators.enrich import Rule, enrich
from rowmill.operators.filters import filter_rows
from rowmill.operators.validate import Check, with_errors

LANDED = "topic string, key string, partition int, offset long, timestamp timestamp, value string"


def read_messages(spark: SparkSession, source: str = "kafka", options: dict | None = None, path: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """topic, key, partition, offset, timestamp and value (text) of a message stream.

    ``source`` kafka needs its package and connection options; ``files`` reads landed JSON files.
    """
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        return raw.select("topic", F.col("key").cast("string"), "partition", "offset", "timestamp",
                          F.col("value").cast("string"))
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def parse_messages(messages: DataFrame, schema: str | None = None) -> DataFrame:
    """Adds ``data``: the value as a struct of ``schema``, or as VARIANT; null where it is no JSON."""
    data = F.try_parse_json("value") if schema is None else F.from_json("value", schema)
    return messages.withColumn("data", data)


def telemetry(messages: DataFrame, device_ids: list[str] | None = None) -> DataFrame:
    """device_id, timestamp, data and quality of device messages; malformed payloads are skipped.

    The device is the ``device_id`` of the payload, or the middle of a ``devices/<id>/telemetry`` topic.
    """
    data = F.try_parse_json("value")
    device = F.coalesce(F.try_variant_get(data, "$.device_id", "string"),
                        F.when(F.col("topic").startswith("devices/"), F.split_part("topic", F.lit("/"), F.lit(2))))
    rows = messages.where(data.isNotNull()).select(
        device.alias("device_id"), "timestamp", F.col("value").alias("payload"), data.alias("data"),
        F.coalesce(F.try_variant_get(data, "$.quality", "string"), F.lit("good")).alias("quality"))
    return rows if device_ids is None else rows.where(F.col("device_id").isin(*device_ids))


def to_messages(df: DataFrame, topic: str, key: str | None = None) -> DataFrame:
    """topic, key and value (JSON) rows, the shape the Kafka sink takes."""
    key_column = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    return df.select(F.lit(topic).alias("topic"), key_column.alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_stream(df: DataFrame, path: str, checkpoint: str, format: str = "json", options: dict | None = None) -> StreamingQuery:
    """Start writing what has arrived; the checkpoint's commit log acknowledges it."""
    return (df.writeStream.format(format).options(**(options or {})).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).outputMode("append").start(path))


def run_rowwise(df: DataFrame, rules: list[Rule] = (), condition: str | None = None, checks: list[Check] = ()) -> DataFrame:
    """Enrichment, filter and validation columns: stateless, so the same on a table and on a stream."""
    kept = filter_rows(enrich(df, list(rules)), condition)
    return with_errors(kept, list(checks)) if checks else kept


def run_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch to a function; aggregates of a stream go through this."""
    return (df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def watch_created(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """A stream of ``created`` events, one per new file: type, path, size, timestamp."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
             .schema("path string, modificationTime timestamp, length long, content binary").load(directory))
    return files.select(F.lit("created").alias("type"), "path", F.col("length").alias("size"),
                        F.col("modificationTime").alias("timestamp"))
