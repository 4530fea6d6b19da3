"""Ingestion of folders with bad files, and documents of several shapes."""

import shutil

from rowmill.sources import ingest, readers
from tests.conftest import rows
from tests.test_files_and_tables import put


def test_bad_files_are_error_rows_and_good_ones_stay(spark, tmp_path):
    root = tmp_path / "in"
    put(root / "a.csv", "id,name\n1,x\n")
    put(root / "b.CSV", "name,id\ny,2\n")
    put(root / "c.json", '{"records": [{"id": 3}]}')
    put(root / "d.json", '{"records": [{"id": 4}')
    put(root / "e.jsonl", '{"id": 5}\nnot json\n\n{"id": 7}\n{"id": \n')
    put(root / "f.odd", "?")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "q"))
    shutil.copy(next((tmp_path / "p").glob("*.parquet")), root / "g h.parquet")
    shutil.copy(next((tmp_path / "q").glob("*.parquet")), root / "empty.parquet")
    put(root / "junk.parquet", "no parquet")
    found = ingest.ingest_directory(spark, str(root))
    assert set(found.frames) == {"csv", "json", "jsonl", "parquet"}
    assert rows(found.frames["csv"], "id", "name") == [("1", "x"), ("2", "y")]
    assert rows(found.frames["json"]) == [(3,)]
    assert found.frames["json"].count() == 1
    assert rows(found.frames["jsonl"], "id") == [(5,), (7,)]
    assert rows(found.frames["parquet"]) == [(0,), (1,), (2,)]
    assert found.frames["parquet"].count() == 3
    errors = sorted((r["source"].rsplit("/", 1)[1], r["error"]) for r in found.errors.collect())
    assert errors == [("d.json", "Malformed JSON"), ("e.jsonl", "Malformed lines: 2"), ("f.odd", "Unknown file type: odd"),
                      ("junk.parquet", "Not a Parquet file")]
    chosen = ingest.ingest_directory(spark, str(root), "[a-d].*")
    assert set(chosen.frames) == {"csv", "json"} and chosen.frames["csv"].count() == 2


def test_nothing_but_bad_files(spark, tmp_path):
    put(tmp_path / "a.json", "{")
    put(tmp_path / "b.parquet", "junk")
    found = ingest.ingest_directory(spark, str(tmp_path))
    assert found.frames == {} and found.errors.count() == 2
    named = ingest.ingest_files(spark, [(str(tmp_path / "none.csv"), "csv"), (str(tmp_path / "a.json"), "json")])
    assert named.frames == {} and named.errors.count() == 2


def test_documents_of_several_shapes_are_parsed_once(spark):
    lines = ['{"data": [{"id": 1, "x": "a"}]}', '{"items": [{"id": "two"}, {"id": "three"}], "id": 9}', '{"data": [], "items": [{"id": "no"}]}',
             '{"id": 7, "x": "own"}', '{"rows": [5, 6]}', '{"data": null, "records": [null, {"id": 8}]}']
    documents = spark.read.json(spark.createDataFrame([(line,) for line in lines], "value string").rdd.map(lambda r: r[0]))
    found = readers.unwrap(documents)
    assert found.columns == ["_value", "id", "x"]
    expected = [(None, "1", "a"), (None, "two", None), (None, "three", None), (None, "7", "own"), (5, None, None), (6, None, None),
                (None, None, None), (None, "8", None)]
    assert rows(found) == sorted(expected, key=repr)
    plan = readers.unwrap(documents, bare=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan
    raw = readers.unwrap(documents, readers.RAW_KEYS, bare=True)
    assert "rows" in raw.columns  # the raw form knows no such list
