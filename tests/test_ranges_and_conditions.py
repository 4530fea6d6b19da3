"""Ranges of any number, conditions that may raise, JSON with repeated keys, files with headers of their own."""

import random

import pytest
from pyspark.sql import functions as F

from rowmill.operators import joins
from tests.conftest import rows


@pytest.mark.parametrize("width, bins", [(256, 1 << 15), (2, 1 << 15), (1, 5)])
def test_ranges_equal_a_plain_search(spark, monkeypatch, width, bins):
    monkeypatch.setattr(joins, "BIN_STRETCHES", width)
    monkeypatch.setattr(joins, "MAX_BINS", bins)
    rng = random.Random(width)
    ranges = []
    for k in range(300):
        low = rng.randrange(200)
        ranges.append((low, low + rng.choice([0, 1, 2, 5, 40]), f"r{k % 40}"))
    ranges += [(None, 5, "x"), (5, None, "x"), (9, 3, "x"), ranges[0], (150, 400, None)]
    values = [None, *range(-3, 420)] * 2
    df = spark.createDataFrame([(v, "kept") for v in values], "v int, low string").repartition(4)
    table = spark.createDataFrame(ranges, "low int, high int, label string")
    found = joins.assign_ranges(df, "v", table, "low", "high", "label", "band")

    def plain(v):
        held = sorted((a, b, c or "") for a, b, c in ranges if None not in (a, b, v) and a <= v <= b)
        return (held[0][2] or None) if held else None

    assert rows(found, "v", "low", "band") == sorted(((v, "kept", plain(v)) for v in values), key=repr)
    assert rows(joins.assign_ranges(df, "v", table.limit(0), "low", "high", "label", "band")) == sorted(((v, "kept", None) for v in values), key=repr)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "t.parquet")
    data = [(1, 0, "x", "2020-01-01"), (6, 2, "7", "bad"), (9, 4, "1", "2021-02-03"), (None, 1, "a", None), (2147483647, 3, "12", "2020-06-01")]
    spark.createDataFrame(data, "a int, b int, s string, d string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("condition, kept", [
    ("a / b > 2", {6, 9, 2147483647}), ("a / b > 2 and a / b < 5", {6, 9}), ("a % b = 0", {6}), ("a div b = 3", {6}), ("cast(s as int) > 6", {6, 2147483647}),
    ("a + 1 > 5", {6, 9}), ("-a * 2 < -10", {6, 9}), ("a / b > 2 or b = 0", {6, 9, 2147483647}), ("b = 0 or a / b > 2", {1, 6, 9, 2147483647}),
    ("not (a / b > 2)", set()), ("case when b = 0 then 9 else a / b end > 2.9", {1, 6, 2147483647}), ("coalesce(a / b, 5) > 4", {None, 2147483647}),
    ("b = 0 or (a / b > 2 and a % (b - 2) = 1)", {1, 9}), ("to_date(d) + 1 > date'2020-01-01' and b = 0", {1}),
    ("a in (6 / b, 3 * b) or a between 2 and 18 / b", {6}), ("exists(array(1, 2), x -> a / b > x)", {6, 9, 2147483647}), ("s like '1%' and a > 1", {9, 2147483647}),
    ("a is null and b / 1 = 1", {None}), ("(a / b) in (3, 2.25)", {6, 9}), ("if(b = 0, 5, a / b) > 4", {1, 2147483647}), ("(s) not like '%)' and (a / b) between 1 and 3", {6, 9}), ("(a /* a / b */ / b) > 2 -- a / 0", {6, 9, 2147483647})])
def test_a_condition_that_raises_is_not_true(odd, condition, kept):
    from rowmill.operators.enrich import Conditional
    from rowmill.operators.filters import filter_rows

    good = odd if "to_date" not in condition else odd.where("d <> 'bad'")
    assert {r["a"] for r in filter_rows(good, condition).collect()} == kept
    got = {r["a"]: r["t"] for r in Conditional("t", condition, "yes", "no").apply(good).collect()}
    assert {a for a, t in got.items() if t == "yes"} == kept and set(got.values()) <= {"yes", "no"}


def test_plain_conditions_reach_the_scan(odd):
    from rowmill.functions.conditions import safe_condition
    from rowmill.operators.filters import filter_rows
    from tests.conftest import plan_of

    assert safe_condition("a > 5 and b = 1", odd) == "a > 5 and b = 1"
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,5)]" in plan_of(filter_rows(odd, "a > 5"))


def test_json_validity_is_that_of_the_standard_parser(spark):
    import json

    from rowmill.functions.text import is_json, json_in_text

    texts = ['{"a":1,"a":2}', '{"a":{"b":1,"b":[1,{"c":1,"c":2}]}}', '[{"a":1,"a":2},3]', '{"a":1,"a":2} x', "1,2", '1,"w":2', "1], [2", '1}, {"v":2', '{"a":1,"a":2}{"b":1}',
             "{'a':1,'a':2}", '{"a":01,"a":2}', '{"a":1,"a":2', '{"a":1 "a":2}', '{"a":"x\ny","a":2}', '{"a":"\\x","a":2}', "", ' {"a":1,"a":2}\n', '{"a":1,"a":2,}', "5", '"x"',
             "null", '{"a":1,}', '{a:1,"b":2,"b":1}', '{"a":1/*c*/,"a":2}', '{"a":tru,"a":2}', '{"a":"}","a":"]"}', "[" * 50 + "]" * 50, '{"":1,"":2}']

    def reads(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for r in df.select("t", is_json(F.col("t")).alias("ok")).collect():
        assert r["ok"] == (None if r["t"] is None else reads(r["t"])), r["t"]
    fenced = spark.createDataFrame([('so:\n```json\n{"a": 1, "a": 2}\n```',)], "t string")
    assert fenced.select(F.from_json(json_in_text(F.col("t")), "a int")["a"]).first()[0] == 2


def _write(folder, files, encoding="utf-8"):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    from rowmill.sources.readers import read_csv

    path = _write(tmp_path / "a", {"one.csv": "\nname,age\nBob,25\n\n\"O, Neil\",\"3\"\"0\"\n", "two.csv": "﻿age,name\n25,Ann\n26\n27,Eve,more\n",
                                   "three.csv": "name,extra,name\r\nold,x,new\r\n", "none.csv": "", "head only.csv": "name,age,zip\n"})
    got = read_csv(spark, path)
    assert sorted(got.columns) == ["age", "extra", "name", "zip"]
    assert rows(got, "name", "age", "extra", "zip") == sorted([
        ("Bob", "25", None, None), ("O, Neil", '3"0', None, None), ("Ann", "25", None, None), (None, "26", None, None), ("Eve", "27", None, None),
        ("new", None, "x", None)], key=repr)
    many = read_csv(spark, path, multi_line=True)
    assert rows(many.where("name in ('Bob', 'Ann', 'Eve')"), "name", "age") == [("Ann", "25"), ("Bob", "25"), ("Eve", "27")]


def test_skipped_lines_and_encoding(spark, tmp_path):
    from rowmill.sources.readers import read_csv

    path = _write(tmp_path / "b", {"one.csv": "título\n\nnaïve;city\nBö;Köln\n", "two.csv": "x\ny\ncity;naïve\nGenève;Zoë\n"}, "latin-1")
    got = read_csv(spark, path, delimiter=";", encoding="ISO-8859-1", skip_rows=2)
    assert rows(got, "naïve", "city") == [("Bö", "Köln"), ("Zoë", "Genève")]
    got = read_csv(spark, path, delimiter=";", encoding="ISO-8859-1", skip_rows=3, has_header=False)
    assert rows(got, "col_0", "col_1") == [("Bö", "Köln"), ("Genève", "Zoë")]
    same = _write(tmp_path / "c", {"one.csv": "a,b\n1,2\n", "two.csv": "a,b\n3,4\n"})
    assert rows(read_csv(spark, same), "a", "b") == rows(read_csv(spark, same, one_header=True), "a", "b") == [("1", "2"), ("3", "4")]
