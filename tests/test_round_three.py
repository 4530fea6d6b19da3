"""Whole results where a part was missing before: long values in profiles, texts with carriage returns, whole texts and all columns in registered queries."""


def test_long_numbers_count_like_short_ones(spark):
    from rowmill.operators import profile

    df = spark.createDataFrame([("9" * 200, "-" + "1" * 150 + ".5", "x" * 200), ("5", "7", "5"), ("5", "word", "6")], "a string, b string, c string")
    found = {r["name"]: r for r in profile.field_profiles(df).collect()}
    assert (found["a"]["type"], found["a"]["min"], found["a"]["max"]) == ("integer", 5.0, float("9" * 200))
    assert (found["b"]["type"], found["c"]["type"], found["c"]["max_length"]) == ("string", "string", 200)
    mixed = sorted(tuple(r) for r in profile.type_conflicts(df).select("name", "value_type", "values").collect())
    assert mixed == [("b", "float", 1), ("b", "integer", 1), ("b", "string", 1), ("c", "integer", 2), ("c", "string", 1)]


def test_registered_queries_take_whole_texts_and_all_columns(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry
    from tests.conftest import SF

    texts = ["one\r\ntwo\r\n", "one\ntwo", "one\rtwo", "", None, " " + "A" * 60]
    spark.createDataFrame([(i, t, "web7") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    queries = entry.queries()
    lines = {r["line"]: r["n"] for r in queries["src_text_all_lines"](spark, str(tmp_path)).collect()}
    assert lines == {"one\r": 1, "two\r": 1, "": 2, "one": 1, "two": 1, "one\rtwo": 1, " " + "A" * 60: 1}
    whole = {r["doc_id"]: r["whole"] for r in queries["scalar_whole_text"](spark, str(tmp_path)).collect()}
    assert whole[5] == hashlib.md5(b"a" * 60).hexdigest() and whole[4] is None
    columns = set(spark.read.parquet(f"{SF}/orders.parquet").columns)
    assert {r["name"] for r in queries["profile_all_target_types"](spark, SF).collect()} == columns
    assert all(c in queries["profile_create_whole_table"](spark, SF).collect()[0][0] for c in columns)
