"""Streaming, batch and renewal queries (ST, UDF, R rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowmill.operators import batch, enrich, renew, validate
from rowmill.operators.aggregate import aggregate
from rowmill.session import staged_path
from rowmill.sources import files
from rowmill.sources.tables import TableStore
from rowmill.streaming import messages as m
from rowmill.streaming.watch import DirectoryWatch
from suite.registry import query, table


def _landed(spark, sf_dir):
    """Events as landed messages of three topics; payloads of errors are cut off."""
    path = staged_path(spark, "messages")
    body = F.to_json(F.struct("event_id", F.col("user_id").cast("string").alias("device_id"), "value"))
    table(spark, sf_dir, "events").select(
        F.concat(F.lit("devices/"), F.col("user_id").cast("string"), F.lit("/telemetry")).alias("topic"),
        F.col("user_id").cast("string").alias("key"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", F.substring(body, 1, 9)).otherwise(body).alias("value"),
    ).repartition(6).write.json(path)
    return path


def _drain(spark, stream, format="parquet"):
    """Run a stream over everything that has landed and read what it wrote."""
    out, state = staged_path(spark, "out"), staged_path(spark, "state")
    run = m.write_stream(stream, out, state, format)
    run.awaitTermination()
    return spark.read.format(format).schema(stream.schema).load(out)


@query("stream_messages", """SELECT 'devices/' || user_id || '/telemetry' AS topic, CAST(user_id AS VARCHAR) AS key, event_id AS offset,
CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def stream_messages(spark, sf_dir):
    stream = m.parse_messages(m.read_messages(spark, "files", path=_landed(spark, sf_dir), files_per_batch=3),
                              "event_id bigint, device_id string, value double")
    return _drain(spark, stream.select("topic", "key", "offset", F.col("data.value").alias("value")))


@query("stream_telemetry", """SELECT CAST(user_id AS VARCHAR) AS device_id, 'good' AS quality, value FROM events
WHERE event_type <> 'error' AND user_id IN (1, 2, 3, 5, 8)""")
def stream_telemetry(spark, sf_dir):
    stream = m.telemetry(m.read_messages(spark, "files", path=_landed(spark, sf_dir)), ["1", "2", "3", "5", "8"])
    return _drain(spark, stream.select("device_id", "quality", F.try_variant_get("data", "$.value", "double").alias("value")))


@query("stream_export", """SELECT 'orders' AS topic, CAST(o_custkey AS VARCHAR) AS key, o_orderkey, o_totalprice FROM orders""")
def stream_export(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(_copied(spark, sf_dir, "orders"))
    sent = _drain(spark, m.to_messages(rows, "orders", "o_custkey"), "json")
    return sent.select("topic", "key", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"),
                       F.get_json_object("value", "$.o_totalprice").cast("double").alias("o_totalprice"))


def _copied(spark, sf_dir, name):
    """The table as a folder of files, which a file stream needs."""
    path = staged_path(spark, name)
    table(spark, sf_dir, name).repartition(4).write.parquet(path)
    return path


_RULES = [enrich.Calculate("double_value", "value * 2"),
          enrich.CategoryMap("band", "value", [(0, 20), (20, 100)], ["low", "mid"]),
          enrich.Conditional("alert", "event_type = 'error'", "yes", "no")]


@query("stream_rowwise", """SELECT event_id, round(value * 2, 4) AS double_value, CASE WHEN value BETWEEN 0 AND 20 THEN 'low'
WHEN value BETWEEN 20 AND 100 OR value >= 100 THEN 'mid' END AS band, CASE WHEN event_type = 'error' THEN 'yes' ELSE 'no' END AS alert,
CAST(value > 300 AS INTEGER) AS n_errors FROM events WHERE value > 5""")
def stream_rowwise(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_copied(spark, sf_dir, "events"))
    stream = m.run_rowwise(rows, _RULES, "value > 5", [validate.Range("value", 0, 300)])
    out = _drain(spark, stream.select("event_id", "double_value", "band", "alert", F.size("errors").alias("n_errors")))
    return out.withColumn("double_value", F.round("double_value", 4))


@query("stream_batches", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_batches(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 2).parquet(
        _copied(spark, sf_dir, "events"))
    out = staged_path(spark, "partials")

    def handle(part, number):
        partial = aggregate(part, ["event_type"], {"n": "count", "total": "sum,value"})
        partial.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    m.run_batches(rows, staged_path(spark, "state"), handle).awaitTermination()
    whole = spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return whole.withColumn("total", F.round("total", 2))


def _watched(spark, sf_dir):
    """A folder with one file per 500 customers."""
    path = staged_path(spark, "watched")
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 500).alias("bucket"), F.col("c_name").alias("value"))
    rows.repartition("bucket").write.partitionBy("bucket").text(path)
    return path


@query("file_events", "SELECT 'created' AS type, count(DISTINCT c_custkey // 500) AS n, count(*) > 0 AS sized FROM customer")
def file_events(spark, sf_dir):
    after = files.list_files(spark, _watched(spark, sf_dir), "*.txt")
    events = files.file_events(after.limit(0), after)
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("size") > 0).alias("sized"))


@query("stream_watch", "SELECT 'created' AS type, count(DISTINCT c_custkey // 500) AS n FROM customer")
def stream_watch(spark, sf_dir):
    seen = _drain(spark, m.watch_created(spark, f"{_watched(spark, sf_dir)}/*", "*.txt"))
    return seen.groupBy("type").agg(F.count_distinct("path").alias("n"))


@query("watch_changes", """WITH a AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'O'),
b AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 = 0 AS INTEGER) AS day FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 1 AS poll, 'created' AS type, k AS size, strftime(day, '%Y-%m-%d') AS day FROM a
UNION ALL SELECT 2, CASE WHEN a.k IS NULL THEN 'created' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END,
coalesce(a.k, b.k), strftime(coalesce(b.day, a.day), '%Y-%m-%d') FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.day <> b.day""")
def watch_changes(spark, sf_dir):
    """Orders as inventories of a folder at two times; the second poll is made by a watch that starts anew."""
    orders = table(spark, sf_dir, "orders")
    inventory = lambda rows, late: rows.select(
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").cast("long").alias("length"),
        F.date_add(F.col("o_orderdate").cast("date"), late).cast("timestamp").alias("modificationTime"))
    state = staged_path(spark, "watch")
    DirectoryWatch(spark, "in", state).poll(inventory(orders.where("o_orderstatus <> 'O'"), F.lit(0)))
    again = DirectoryWatch(spark, "in", state)
    again.poll(inventory(orders.where("o_orderkey % 5 <> 0"), (F.col("o_orderkey") % 3 == 0).cast("int")))
    return again.events().select(F.col("poll").cast("int").alias("poll"), "type", "size", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


def _halve(key):
    if key % 5 == 0:
        raise ValueError(f"odd lot {key}")
    return key * 2


_ACTIONS = [_halve, lambda x: x + 10]


@query("batch_chain", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 2 + 10 END AS output,
CASE WHEN p_partkey % 5 = 0 THEN 'odd lot ' || p_partkey END AS error, true AS processed FROM part""")
def batch_chain(spark, sf_dir):
    return batch.run_actions(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _ACTIONS, "long")


@query("batch_errors", "SELECT p_partkey, 'odd lot ' || p_partkey AS error FROM part WHERE p_partkey % 5 = 0")
def batch_errors(spark, sf_dir):
    results = batch.run_actions(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _ACTIONS, "long")
    return batch.errors(results).select("p_partkey", "error")


@query("batch_tally", """SELECT count(*) AS items, count(*) FILTER (p_partkey % 5 <> 0) AS success_count,
count(*) FILTER (p_partkey % 5 = 0) AS error_count FROM part""")
def batch_tally(spark, sf_dir):
    return batch.tally(batch.run_actions(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", _ACTIONS, "long"))


@query("renew_full", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def renew_full(spark, sf_dir):
    store, name = TableStore(spark), f"t_{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    store.overwrite(name, orders)
    store.overwrite(name, orders.where("o_orderstatus = 'O'"))
    return store.load(name).drop("o_orderstatus")


@query("renew_incremental", """WITH o AS (SELECT event_id, event_type FROM events WHERE event_type = 'click' AND value > 100)
SELECT event_id, event_type FROM o UNION ALL SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM o)""")
def renew_incremental(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.where("event_type = 'click' and value > 100").select("event_id", "event_type")
    return renew.incremental(old, events.select("event_id", "event_type"), "event_id")


@query("renew_timestamp", """SELECT event_id, value FROM events WHERE ts > (SELECT max(ts) FROM events WHERE value > 400)""")
def renew_timestamp(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return renew.newer_rows(events.where("value > 400"), events, "ts").select("event_id", "value")


@query("renew_cdc", """
WITH c AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, value FROM c WHERE k = 1 AND event_type <> 'error'""")
def renew_cdc(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "event_id",
        F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation"))
    return renew.apply_changes(target, changes, "c_custkey", "event_id")


@query("renew_versioned", """SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to,
lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS is_current FROM events""")
def renew_versioned(spark, sf_dir):
    return renew.versions(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")
