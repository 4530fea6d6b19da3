"""Source, sink, envelope and table queries (S, K, P rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowmill.operators.setops import union_by_name
from rowmill.session import staged_path
from rowmill.sources import envelope, files, ingest, readers, writers
from rowmill.sources.tables import TableStore
from suite.registry import query, table

_CUSTOMER = "CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("src_csv_roundtrip", f"SELECT {_CUSTOMER} FROM customer")
def src_csv_roundtrip(spark, sf_dir):
    path = staged_path(spark, "customer")
    writers.write_csv(_customers(spark, sf_dir), path, delimiter=";", quotechar="'")
    return readers.read_csv(spark, path, delimiter=";", quotechar="'")


@query("src_csv_multiline", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(replace(text, chr(13) || chr(10), chr(10))) AS text FROM documents")
def src_csv_multiline(spark, sf_dir):
    path = staged_path(spark, "documents")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    read = readers.read_csv(spark, path, multi_line=True)
    return read.select("doc_id", F.md5(files.unix_lines(F.col("text"))).alias("text"))


@query("src_csv_no_header", """SELECT CAST(o_orderkey AS VARCHAR) AS col_0, o_orderpriority AS col_1 FROM orders""")
def src_csv_no_header(spark, sf_dir):
    path = staged_path(spark, "orders")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").write.csv(path)
    return readers.read_csv(spark, path, has_header=False)


@query("src_csv_skip_rows", """SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS name FROM part""")
def src_csv_skip_rows(spark, sf_dir):
    path = staged_path(spark, "part")
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    ordered = table(spark, sf_dir, "part").select(line.alias("value")).repartition(4)
    ordered.mapInPandas(_with_preamble, "value string").write.text(path)
    return readers.read_csv(spark, path, skip_rows=2)


def _with_preamble(batches):
    import pandas as pd

    yield pd.DataFrame({"value": ["exported parts", "second line", "part,name"]})
    yield from batches


@query("src_json_envelope", """SELECT event_id, value FROM events WHERE user_id % 3 <> 2
UNION ALL SELECT arg_min(event_id, event_id), arg_min(value, event_id) FROM events WHERE user_id % 3 = 2
GROUP BY user_id, event_id // 1000""")
def src_json_envelope(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    path = staged_path(spark, "documents")
    first = F.min_by(F.struct("event_id", "value"), "event_id")
    place = F.col("user_id") % 3
    # one document per user and thousand events, so a busy user has several
    listed = events.groupBy("user_id", F.floor(F.col("event_id") / 1000)).agg(F.collect_list(F.struct("event_id", "value")).alias("all"), first.alias("first"))
    listed.select(F.to_json(F.struct(
        F.when(place == 0, F.col("all")).alias("records"), F.when(place == 1, F.col("all")).alias("data"),
        F.when(place == 2, F.col("first.event_id")).alias("event_id"),
        F.when(place == 2, F.col("first.value")).alias("value"))).alias("value")).write.text(path)
    return readers.unwrap(readers.read_json_lines(spark, path)).select("event_id", "value")


@query("src_json_raw", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus AS state, NULL AS n FROM orders WHERE o_custkey % 4 < 3
UNION ALL SELECT NULL, NULL, count(*) FROM orders WHERE o_custkey % 4 = 3 GROUP BY o_custkey""")
def src_json_raw(spark, sf_dir):
    """Documents that name no format: ``rows`` is no list of records there, and keys of one list are text, of the others numbers."""
    path = staged_path(spark, "raw")
    orders, place = table(spark, sf_dir, "orders"), F.col("o_custkey") % 4
    item = lambda key: F.struct(key.alias("o_orderkey"), F.col("o_orderstatus").alias("state"))
    listed = orders.groupBy("o_custkey").agg(F.collect_list(item(F.col("o_orderkey"))).alias("plain"), F.count(F.lit(1)).alias("n"),
                                             F.collect_list(item(F.col("o_orderkey").cast("string"))).alias("text"))
    listed.select(F.to_json(F.struct(
        *[F.when(place == i, F.col(c)).alias(k) for i, (k, c) in enumerate([("results", "plain"), ("data", "text"), ("items", "plain")])],
        F.when(place == 3, F.col("plain")).alias("rows"), F.when(place == 3, F.col("n")).alias("n"))).alias("value")).write.text(path)
    return readers.unwrap(readers.read_json_lines(spark, path), readers.RAW_KEYS).select("o_orderkey", "state", "n")


@query("src_jsonl_roundtrip", "SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'P') AS state FROM orders")
def src_jsonl_roundtrip(spark, sf_dir):
    path = staged_path(spark, "orders")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                 F.expr("nullif(o_orderstatus, 'P')").alias("state"))
    writers.write_json_lines(rows, path)
    return readers.read_json_lines(spark, path)


@query("src_xml_roundtrip", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
c_mktsegment AS last_tag FROM customer""")
def src_xml_roundtrip(spark, sf_dir):
    path = staged_path(spark, "customer")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("@id"), F.col("c_name").alias("name"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("place"),
        F.array(F.lit("customer"), F.col("c_mktsegment")).alias("tag"))
    writers.write_xml(rows, path)
    read = readers.read_xml(spark, path)
    return read.select(F.col("`@id`").alias("id"), "name", F.col("place.nation").alias("nation"), F.col("tag").alias("last_tag"))


@query("src_text_all_lines", """SELECT line, CAST(count(*) AS BIGINT) AS n FROM (
SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""")
def src_text_all_lines(spark, sf_dir):
    path = staged_path(spark, "text")
    texts = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())  # a null text has no line
    texts.select(F.col("text").alias("value")).write.option("lineSep", "\n").text(path)
    return readers.read_text(spark, path, "\n").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("src_parquet_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_parquet_roundtrip(spark, sf_dir):
    path = staged_path(spark, "supplier")
    writers.write_parquet(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_parquet(spark, path)


@query("src_binary_listing", """SELECT c_custkey // 500 AS bucket, CAST(count(*) * 33 AS BIGINT) AS length,
md5(string_agg(md5(CAST(c_custkey AS VARCHAR)) || chr(10), '' ORDER BY c_custkey)) AS content_md5 FROM customer GROUP BY ALL""")
def src_binary_listing(spark, sf_dir):
    path = staged_path(spark, "files")
    lines = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 500).alias("bucket"), "c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("value"))
    (lines.repartition("bucket").sortWithinPartitions("bucket", "c_custkey")
     .select("bucket", "value").write.partitionBy("bucket").text(path))
    listing = files.list_files(spark, path, "*.txt")
    return listing.select(F.col("bucket").cast("long").alias("bucket"), "length", files.content_hash().alias("content_md5"))


def _detectable(spark, sf_dir):
    """Pages as files: name and leading bytes vary with the page."""
    k = F.col("page_id") % 8
    name = F.lit("noext")
    lead = F.lit("")
    for i, (extension, magic) in enumerate([("XLSM", ""), ("docx", "504B0304"), ("bin", "EFBBBF"), ("dat", "25504446"),
                                            ("old", "D0CFED00"), ("json", ""), ("png", "89504E470D0A1A0A")]):
        name = F.when(k == i, F.lit(f"file.{extension}")).otherwise(name)
        lead = F.when(k == i, F.lit(magic)).otherwise(lead)
    body = F.concat(F.unhex(lead), F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/data/v1.2/"), name).alias("path"), body.alias("content"))


@query("src_detect_type", """SELECT page_id, ['xlsx', 'docx', 'csv', 'pdf', 'xls', 'json', 'png', 'unknown'][page_id % 8 + 1] AS type,
['xlsx', 'docx', 'bin', 'dat', 'old', 'json', 'png', ''][page_id % 8 + 1] AS extension,
CASE WHEN page_id % 8 = 6 THEN 'png' END AS image FROM pages""")
def src_detect_type(spark, sf_dir):
    return _detectable(spark, sf_dir).select(
        "page_id", files.detect_type().alias("type"), files.type_by_extension().alias("extension"),
        files.image_type().alias("image"))


@query("src_ingest_batch", """
SELECT 'csv' AS kind, CAST(s_suppkey AS BIGINT) AS key, s_name AS name FROM supplier
UNION ALL SELECT 'json', c_custkey, c_name FROM customer
UNION ALL SELECT 'parquet', p_partkey, p_name FROM part
UNION ALL SELECT 'error', NULL, 'Unknown file type: odd' FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)""")
def src_ingest_batch(spark, sf_dir):
    root = staged_path(spark, "mixed")
    pick = lambda name, p: table(spark, sf_dir, name).select(F.col(f"{p}key").alias("key"), F.col(f"{p[0]}_name").alias("name"))
    pick("supplier", "s_supp").write.option("header", True).csv(f"{root}/a")
    pick("customer", "c_cust").write.json(f"{root}/b")
    pick("part", "p_part").write.parquet(f"{root}/c")
    # Spark's JSON files hold one record per line, which is the jsonl reader's format.
    found = ingest.ingest_files(spark, [(f"{root}/a", "csv"), (f"{root}/b", "jsonl"), (f"{root}/c", "parquet"), (f"{root}/x.odd", "odd")])
    parts = [frame.select(F.lit("json" if kind == "jsonl" else kind).alias("kind"), F.col("key").cast("long").alias("key"), "name")
             for kind, frame in found.frames.items()]
    errors = found.errors.select(F.lit("error").alias("kind"), F.lit(None).cast("long").alias("key"), F.col("error").alias("name"))
    return union_by_name([*parts, errors]).select("kind", "key", "name")


@query("src_ingest_mixed_headers", """
SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, NULL AS segment, NULL AS size FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, NULL FROM customer
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name || ', "new"', NULL, CAST(p_size AS VARCHAR) FROM part""")
def src_ingest_mixed_headers(spark, sf_dir):
    """Three tables as CSV files of one folder, each with its columns in another order."""
    root = staged_path(spark, "headers")
    parts = [table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name"),
             table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_mktsegment AS segment", "c_custkey AS key"),
             table(spark, sf_dir, "part").selectExpr("p_size AS size", "p_name || ', \"new\"' AS name", "p_partkey AS key")]
    for part in parts:
        part.write.mode("append").options(header=True, escape='"').csv(root)
    found = ingest.ingest_files(spark, [(root, "csv")])
    return found.frames["csv"].select("key", "name", "segment", "size")


@query("src_ingest_bad_file", """
SELECT 'json' AS kind, CAST(c_custkey AS BIGINT) AS key, c_name AS name FROM customer WHERE c_custkey // 500 % 5 <> 2
UNION ALL SELECT 'jsonl', s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'parquet', p_partkey, p_name FROM part
UNION ALL SELECT 'error', count(DISTINCT c_custkey // 500), 'Malformed JSON' FROM customer WHERE c_custkey // 500 % 5 = 2 HAVING count(*) > 0
UNION ALL SELECT 'error', count(*), 'Malformed lines' FROM supplier WHERE s_suppkey % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'error', count(*), 'Not a Parquet file' FROM region""")
def src_ingest_bad_file(spark, sf_dir):
    """Documents cut in the middle, lines that are no JSON, and texts among Parquet files."""
    root = staged_path(spark, "bad")
    pick = lambda name, p: table(spark, sf_dir, name).select(F.col(f"{p}key").alias("key"), F.col(f"{p[0]}_name").alias("name"))
    block = F.floor(F.col("key") / 500)
    documents = pick("customer", "c_cust").groupBy(block.alias("block")).agg(F.to_json(F.struct(
        F.collect_list(F.struct("key", "name")).alias("records"))).alias("value"))
    cut = F.when(F.col("block") % 5 == 2, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    documents.select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/a")
    lines = pick("supplier", "s_supp").select("key", F.to_json(F.struct("key", "name")).alias("value"))
    lines.select(F.when(F.col("key") % 7 == 0, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("value")).write.text(f"{root}/b")
    pick("part", "p_part").write.parquet(f"{root}/c")
    table(spark, sf_dir, "region").select("r_name").write.mode("append").option("maxRecordsPerFile", 1).text(f"{root}/c")
    found = ingest.ingest_files(spark, [(f"{root}/a", "json"), (f"{root}/b", "jsonl"), (f"{root}/c", "parquet")])
    parts = [frame.select(F.lit(kind).alias("kind"), F.col("key").cast("long").alias("key"), "name") for kind, frame in found.frames.items()]
    counted = F.regexp_extract("error", r": (\d+)$", 1).try_cast("long")
    errors = found.errors.groupBy(F.regexp_replace("error", ":.*", "").alias("name")).agg(F.sum(F.coalesce(counted, F.lit(1))).alias("key"))
    return union_by_name([*parts, errors.withColumn("kind", F.lit("error"))]).select("kind", "key", "name")


@query("src_pages_concat", """
WITH p AS (SELECT event_id // 50 AS page, count(*) AS n, max(value) > 470 AS done FROM events GROUP BY 1)
SELECT event_id // 50 AS page, event_id, value FROM events
WHERE event_id // 50 <= coalesce((SELECT min(page) FROM p WHERE n < 50 OR done), 1000000)""")
def src_pages_concat(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 50))
    landed = events.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("items"), (F.max("value") <= 470).alias("has_more"))
    bodies = landed.select("page", F.when(F.col("page") % 2 == 0, F.to_json(F.struct("items", "has_more"))).when(
        F.col("has_more"), F.to_json("items")).otherwise(F.to_json(F.struct(F.col("items").alias("results"), "has_more"))).alias("body"))
    out = ingest.concat_pages(bodies, "page", "body", "struct<event_id: bigint, value: double>", page_size=50, max_pages=10_000_000)
    return out.select("page", "item.event_id", "item.value")


# ---- envelope -------------------------------------------------------------------------------------

_PATH = "in/customers.csv"


def _wrapped(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custKey"), F.col("c_name").alias("Full Name"), "c_acctbal")
    return envelope.envelope(rows, "custKey", "csv", "file", _PATH, include_raw=True)


@query("norm_envelope", f"""SELECT substr(md5('{_PATH}'), 1, 8) || '_' || (row_number() OVER (ORDER BY c_custkey) - 1) AS _id,
c_custkey AS cust_key, c_name AS full_name, c_name AS raw_name FROM customer""")
def norm_envelope(spark, sf_dir):
    path = staged_path(spark, "envelope")
    envelope.export(_wrapped(spark, sf_dir), path)
    records = readers.read_json_lines(spark, f"{path}/records")
    return records.select("_id", "_source.cust_key", "_source.full_name", F.get_json_object("_raw", "$['Full Name']").alias("raw_name"))


@query("norm_metadata", """SELECT 'csv' AS source_type, 'file' AS source_channel, 'in/customers.csv' AS source_path,
CAST(count(*) AS BIGINT) AS record_count, 'custKey,Full Name,c_acctbal' AS columns,
substr(md5('Full Name,c_acctbal,custKey'), 1, 12) AS schema_hash, 'flatten' AS data_category FROM customer""")
def norm_metadata(spark, sf_dir):
    return _wrapped(spark, sf_dir).metadata.withColumn("columns", F.array_join("columns", ",")).drop("parsed_at")


@query("norm_denormalize", "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal FROM customer")
def norm_denormalize(spark, sf_dir):
    return envelope.denormalize(_wrapped(spark, sf_dir).records)


@query("norm_unwrap", "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal FROM customer")
def norm_unwrap(spark, sf_dir):
    """An exported envelope is read again and its records taken out."""
    path = staged_path(spark, "envelope")
    envelope.export(_wrapped(spark, sf_dir), path)
    return envelope.unwrap_records(readers.read_json_lines(spark, f"{path}/records")).select("cust_key", "full_name", "c_acctbal")


@query("norm_merge", """SELECT 'merged' AS source_type, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT)
AS record_count, 'c_acctbal,custKey,full_name,s_acctbal,s_name' AS columns, 'flatten' AS data_category""")
def norm_merge(spark, sf_dir):
    suppliers = envelope.envelope(table(spark, sf_dir, "supplier").select("s_name", "s_acctbal", F.col("s_suppkey").alias("custKey")),
                                  "custKey", "parquet")
    merged = envelope.merge([_wrapped(spark, sf_dir), suppliers])
    return merged.metadata.select("source_type", "record_count",
                                  F.regexp_replace(F.array_join("columns", ","), "cust_key", "custKey").alias("columns"), "data_category")


# ---- tables ---------------------------------------------------------------------------------------


def _store(spark):
    return TableStore(spark), f"t_{uuid.uuid4().hex}"


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))


_S = "SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


@query("store_append_load", f"SELECT * FROM ({_S}) UNION ALL SELECT c_custkey, c_name, c_acctbal, NULL FROM ({_S}) WHERE c_acctbal < 0")
def store_append_load(spark, sf_dir):
    store, name = _store(spark)
    rows = _suppliers(spark, sf_dir)
    store.store(name, rows)
    store.store(name, rows.where("c_acctbal < 0").drop("segment").withColumn("unknown", F.lit(1)))
    store.store(name, rows.limit(0))
    return store.load(name)


@query("store_load_filtered", f"SELECT * FROM ({_S}) WHERE segment = 'MACHINERY' ")
def store_load_filtered(spark, sf_dir):
    store, name = _store(spark)
    store.store(name, _suppliers(spark, sf_dir))
    return store.load(name, {"segment": "MACHINERY"})


@query("store_exists", f"SELECT count(*) AS n, count(*) > 0 AS stored, false AS never FROM ({_S})")
def store_exists(spark, sf_dir):
    store, name = _store(spark)
    store.store(name, _suppliers(spark, sf_dir))
    return store.load(name).select(F.count(F.lit(1)).alias("n")).withColumns(
        {"stored": F.lit(store.exists(name)), "never": F.lit(store.exists(f"{name}x"))})


@query("store_insert_ignore", f"""SELECT * FROM ({_S}) WHERE c_acctbal < 5000
UNION ALL SELECT c_custkey, 'late', c_acctbal, segment FROM ({_S}) WHERE c_acctbal >= 5000""")
def store_insert_ignore(spark, sf_dir):
    store, name = _store(spark)
    rows = _suppliers(spark, sf_dir)
    store.store_new(name, rows.where("c_acctbal < 5000"), ["c_custkey"])
    store.store_new(name, rows.withColumn("c_name", F.lit("late")), ["c_custkey"])
    return store.load(name)


@query("store_overwrite", f"SELECT * FROM ({_S}) WHERE c_acctbal > 0")
def store_overwrite(spark, sf_dir):
    store, name = _store(spark)
    rows = _suppliers(spark, sf_dir)
    store.overwrite(name, rows)
    store.overwrite(name, rows.where("c_acctbal > 0"), ttl_seconds=3600)
    return store.load(name)


@query("store_versions", f"""SELECT 1 AS number, c_custkey, c_name, segment, NULL AS orders FROM ({_S})
UNION ALL SELECT 2, o_custkey, NULL, NULL, count(*) FROM orders GROUP BY o_custkey""")
def store_versions(spark, sf_dir):
    """A table replaced by one of other columns; the version before stays readable."""
    store, name = _store(spark)
    store.overwrite(name, _suppliers(spark, sf_dir))
    store.overwrite(name, table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders")))
    before = store.load(name, number=1).select(F.lit(1).alias("number"), "c_custkey", "c_name", "segment")
    return before.unionByName(store.load(name).withColumn("number", F.lit(2)), allowMissingColumns=True)


@query("store_update", f"""SELECT c_custkey, c_name, CASE WHEN segment = 'MACHINERY' THEN 1.0 ELSE c_acctbal END AS c_acctbal, segment,
(SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS hits FROM ({_S})""")
def store_update(spark, sf_dir):
    store, name = _store(spark)
    store.store(name, _suppliers(spark, sf_dir))
    hits = store.update(name, {"segment": "MACHINERY"}, {"c_acctbal": 1})
    return store.load(name).withColumn("hits", F.lit(hits).cast("long"))


@query("store_delete", f"""SELECT *, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS hits FROM ({_S})
WHERE segment IS NULL OR segment <> 'MACHINERY'""")
def store_delete(spark, sf_dir):
    store, name = _store(spark)
    store.store(name, _suppliers(spark, sf_dir))
    hits = store.delete(name, {"segment": "MACHINERY"})
    return store.load(name).withColumn("hits", F.lit(hits).cast("long"))
