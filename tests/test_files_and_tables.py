"""Readers, writers, tables, ingestion and streams on small files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from rowmill.operators import documents
from rowmill.sources import envelope, files, ingest, jdbc, readers, writers
from rowmill.sources.receipts import insert_receipts
from rowmill.sources.tables import TableStore
from rowmill.streaming import messages
from tests.conftest import rows


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_options(spark, tmp_path):
    path = put(tmp_path / "a.csv", "note\nname,age\nAlice,30\n\"B, C\",25\n")
    assert rows(readers.read_csv(spark, path, skip_rows=1)) == [("Alice", "30"), ("B, C", "25")]
    plain = put(tmp_path / "b.csv", "x;1\r\ny;2;3\r\nz\r\n")
    df = readers.read_csv(spark, plain, delimiter=";", has_header=False)
    assert df.columns == ["col_0", "col_1"] and rows(df) == [("x", "1"), ("y", "2"), ("z", None)]


@pytest.mark.parametrize("content,n", [('[{"id": 1}, {"id": 2}]', 2), ('{"records": [{"id": 1}, {"id": 2}]}', 2), ('{"id": 9}', 1),
                                       ('{"rows": [{"id": 1}], "items": [{"id": 2}, {"id": 3}]}', 2)])
def test_json_documents(spark, tmp_path, content, n):
    assert readers.read_json(spark, put(tmp_path / "a.json", content)).count() == n


def test_json_lines_skip_blank_lines(spark, tmp_path):
    assert readers.read_json_lines(spark, put(tmp_path / "a.json", '{"id": 1}\n\n{"id": 2}\n{"id": 3}\n')).count() == 3


def test_xml(spark, tmp_path):
    path = put(tmp_path / "a.xml", '<root><record id="1" type="A"><name>x</name><t>1</t><t>2</t></record><record id="2"><name>y</name></record></root>')
    df = readers.read_xml(spark, path)
    assert rows(df, "`@id`", "`@type`", "name", "t") == [("1", "A", "x", "2"), ("2", None, "y", None)]


def test_yaml_and_excel(spark, tmp_path):
    path = put(tmp_path / "a.yaml", "records:\n- name: Alice\n  age: 30\n- name: Bob\n  age: 25\n")
    assert rows(readers.read_yaml(spark, path), "name", "age") == [("Alice", 30), ("Bob", 25)]
    out = str(tmp_path / "books")
    made = writers.write_excel(spark.range(25).select("id", F.concat(F.lit("<n>"), "id").alias("n")).coalesce(1), out, rows_per_file=10)
    assert made.count() == 3 and readers.read_excel(spark, out).count() == 25
    assert {r["sheet"] for r in readers.excel_sheets(spark, out).collect()} == {"Sheet1"}


def test_ingestion_keeps_going(spark, tmp_path):
    put(tmp_path / "in/a.csv", "id\n1\n")
    put(tmp_path / "in/b.json", '[{"id": 2}]')
    put(tmp_path / "in/c.odd", "?")
    put(tmp_path / "in/d.parquet", "no parquet")
    found = ingest.ingest_directory(spark, str(tmp_path / "in"))
    assert set(found.frames) == {"csv", "json"} and found.errors.count() == 2


def test_file_types_and_events(spark, tmp_path):
    put(tmp_path / "d/a.csv", b"\xef\xbb\xbfid\n")
    put(tmp_path / "d/b", b"%PDF-1")
    put(tmp_path / "d/c.xlsm", b"x")
    listing = files.list_files(spark, str(tmp_path / "d")).checkpoint()
    assert rows(listing.select(files.file_name(), files.detect_type())) == [("a.csv", "csv"), ("b", "pdf"), ("c.xlsm", "xlsx")]
    put(tmp_path / "d/e.txt", "new")
    (tmp_path / "d/b").unlink()
    after = files.list_files(spark, str(tmp_path / "d"))
    assert rows(files.file_events(listing, after).select("type", files.file_name())) == [("created", "e.txt"), ("deleted", "b")]


def test_envelope(spark):
    df = spark.sql("select 2 as userID, 'b' as `Full Name` union all select 1, 'a'")
    made = envelope.envelope(df, "userID", "csv", path="p.csv", generate_ids=False)
    assert rows(made.records.select("_id", "_source.user_id", "_source.full_name")) == [("0", 1, "a"), ("1", 2, "b")]
    assert made.metadata.first()["record_count"] == 2


def test_pages_stop(spark):
    body = lambda n, **more: json.dumps({"items": [{"id": i} for i in range(n)], **more})
    pages = lambda *bodies: spark.createDataFrame(list(enumerate(bodies, 1)), "page int, body string")
    count = lambda df, **how: ingest.concat_pages(df, "page", "body", "struct<id: int>", page_size=2, **how).count()
    assert count(pages(body(2), body(1), body(2))) == 3
    assert count(pages(body(2), body(2, has_more=False), body(2))) == 4
    assert count(pages("[{\"id\": 1}, {\"id\": 2}]", "[]", body(2))) == 2
    assert count(pages(body(2), body(2), body(2)), max_pages=2) == 4
    assert count(pages(body(2), '{"x": 1}', body(2))) == 2


def test_jdbc_reader_options_need_no_database(spark):
    assert jdbc.reader(spark, "jdbc:none:x", "select 1") is not None
    assert jdbc.reader(spark, "jdbc:none:x", "select 1", partition_column="id", lower=0, upper=9, partitions=3) is not None


def test_table_store(spark, tmp_path):
    store, name = TableStore(spark, str(tmp_path / "tables")), f"t_{uuid.uuid4().hex}"
    people = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, None)], "id int, name string")
    store.store(name, people.limit(0))
    assert not store.exists(name)
    store.store(name, people)
    assert rows(store.load(name, {"id": 1}), "name") == [("alice",)]
    assert store.update(name, {"name": "bob"}, {"name": "rob"}) == 1 and store.update(name, {}, {"name": "x"}) == 0
    assert store.delete(name, {"name": "alice"}) == 1 and store.delete(name, {}) == 0
    assert rows(store.load(name)) == [(2, "rob"), (3, None)]
    store.store_new(name, people, ["id"])
    assert rows(store.load(name), "id") == [(1,), (2,), (3,)]
    store.overwrite(name, people.limit(1), ttl_seconds=-5)
    assert store.exists(name) and store.load(name).count() == 0


def test_receipts_are_added_once(spark, tmp_path):
    store, prefix = TableStore(spark, str(tmp_path / "tables")), f"t_{uuid.uuid4().hex}_"
    text = json.dumps({"merchant": {"name": "S"}, "items": [{"description": "d", "quantity": "2"}], "summary": {"tax_breakdown": []}})
    df = spark.createDataFrame([("a.png", text), ("b.png", "no json"), ("a.png", text)], "filename string, raw string")
    parsed = documents.parse_documents(df, "filename", "raw")
    assert insert_receipts(store, parsed, prefix).count() == 1
    assert insert_receipts(store, parsed, prefix).count() == 0
    assert store.load(prefix + "receipt_items").count() == 1
    assert rows(documents.rejects(parsed)) == [("b.png", "no json")]


def test_stream_equals_batch(spark, tmp_path):
    data = spark.range(50).select(F.lit("devices/7/telemetry").alias("topic"), F.lit("k").alias("key"), F.lit(0).alias("partition"),
                                  F.col("id").alias("offset"), F.current_timestamp().alias("timestamp"),
                                  F.when(F.col("id") % 5 == 0, "{oops").otherwise(F.to_json(F.struct("id"))).alias("value"))
    data.repartition(3).write.json(str(tmp_path / "in"))
    shape = lambda df: messages.telemetry(df, ["7"]).select("device_id", "payload", "quality")
    stream = shape(messages.read_messages(spark, "files", path=str(tmp_path / "in"), files_per_batch=1))
    messages.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.json(str(tmp_path / "out")), "device_id", "payload", "quality") == rows(shape(data))
