"""Cases that went wrong before: script-wide patterns, second 60, columns of some files only, mixed kinds, rows without an expiry."""

from pyspark.sql import functions as F

from rowmill.functions.text import is_time_text
from rowmill.operators.aggregate import aggregate
from rowmill.operators.batch import run_actions
from rowmill.operators.enrich import Calculate
from rowmill.operators.filters import filter_rows
from rowmill.operators.setops import union_by_name
from rowmill.operators.validate import Pattern
from rowmill.sources.readers import read_parquet
from rowmill.sources.tables import TableStore
from tests.conftest import rows


def test_pattern_takes_letters_of_any_script(spark):
    df = spark.createDataFrame([("été",), ("a b",)], "s string")
    assert rows(df.select("s", Pattern("s", pattern=r"\w+$").failure(df).alias("e"))) == [("a b", "s does not match pattern"), ("été", None)]


def test_second_sixty_is_no_time(spark):
    df = spark.createDataFrame([("10:00:59",), ("10:00:60",), ("10:00",)], "s string")
    assert rows(df.select("s", is_time_text(F.col("s")))) == [("10:00", True), ("10:00:59", True), ("10:00:60", False)]


def test_parquet_files_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(2, "b")], "a int, b string").write.parquet(str(tmp_path / "y"))
    assert rows(read_parquet(spark, [str(tmp_path / "x"), str(tmp_path / "y")])) == [(1, None), (2, "b")]


def test_union_of_text_and_numbers(spark):
    a, b = spark.createDataFrame([("n/a",)], "v string"), spark.createDataFrame([(1,)], "v int")
    assert rows(union_by_name([a, b])) == [("1",), ("n/a",)]


def test_rows_appended_to_a_table_with_a_time_to_live_are_loaded(spark):
    store = TableStore(spark)
    store.overwrite("ttl_rows", spark.createDataFrame([(1, "a")], "id int, name string"), ttl_seconds=3600)
    store.store("ttl_rows", spark.createDataFrame([(2, "b")], "id int, name string"))
    assert rows(store.load("ttl_rows")) == [(1, "a"), (2, "b")]


def test_lists_of_a_large_group_lose_nothing_and_scalars_count_once(spark):
    df = spark.range(400_000).selectExpr("id", "if(id % 5 < 4, 'hot', concat('k', id % 50)) key", "hash(id) value").repartition(40)
    out = aggregate(df, ["key"], {"n": "count", "ids": "list,id", "vs": "list,value"}, "id", max_items=7000).cache()
    sizes = out.selectExpr("sum(n) n", "sum(size(ids)) ids", "sum(size(vs)) vs", "count_if(size(ids) <> size(vs)) uneven").first()
    assert tuple(sizes) == (400_000, 400_000, 400_000, 0)
    hot = out.where("key = 'hot'").orderBy("part").select("part", F.size("ids"), F.col("ids")[0]).collect()
    assert [r[0] for r in hot] == list(range(46)) and [r[1] for r in hot] == [7000] * 45 + [5000]
    assert [r[2] for r in hot] == [7000 * k // 4 * 5 + 7000 * k % 4 for k in range(46)]


def test_actions_get_integers_and_none(spark):
    df = spark.createDataFrame([(1,), (None,)], "v long")
    shown = run_actions(df, "v", [repr])
    assert rows(shown, "v", "output") == [(1, "1"), (None, "None")]
    wrong = run_actions(df, "v", [lambda v: v if v is None else "x"], "long")
    assert rows(wrong.selectExpr("v", "output", "error is not null")) == [(1, None, True), (None, None, False)]


def test_text_in_expressions_stays_text(spark):
    df = spark.createDataFrame([("Ann", "Lee", "2.5", 1), ("Bo", "Bo", "x", 2)], "first string, last string, n string, i int")
    value = lambda e: [r[0] for r in Calculate("out", e).apply(df).orderBy("i").select("out").collect()]
    assert value("concat(first, ' ', last)") == ["Ann Lee", "Bo Bo"] and value("upper(first)") == ["ANN", "BO"]
    assert value("n * 2") == [5.0, None] and value("if(n is null, 0, n + i)") == [3.5, 0]
    assert value("case when n = 'x' then first else last end") == ["Lee", "Bo"]
    kept = lambda e: [r[0] for r in filter_rows(df, e).select("i").collect()]
    assert kept("first == last") == [2] and kept("length(first) > 2") == [1] and kept('last == "Lee"') == [1]
    assert kept("first between 'A' and 'B'") == [1] and kept("n > 2") == [1] and kept("n + n > 4") == [1]
