"""Small cases with literal results."""

import pytest
from pyspark.sql import functions as F

from rowmill.functions import dates, names, text
from rowmill.operators import (
    aggregate, batch, classify, encoding, enrich, filters, joins, noise, profile, reshape, sampling, scaling, setops, validate)
from rowmill.plans.value_add import run, transform
from tests.conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_calculate(spark):
    df = frame(spark, [(1, 100, 2), (2, 50, 3)], "id int, price int, quantity int")
    assert rows(enrich.Calculate("total", "price * quantity").apply(df), "total") == [(150,), (200,)]


def test_calculate_reads_numeric_text(spark):
    df = frame(spark, [("2.5", "4"), (" 3 ", "1_000"), ("1e3", "2"), ("x", "1")], "a string, b string")
    out = enrich.Calculate("c", "a * b").apply(df)
    assert [r["c"] for r in out.collect()] == [10.0, 3000.0, None, None]
    assert out.columns == ["a", "b", "c"] and out.first()["a"] == "2.5"


def test_later_rules_see_earlier_fields(spark):
    df = frame(spark, [(1, 2)], "a int, b int")
    out = enrich.enrich(df, [enrich.Calculate("c", "a + b"), enrich.Calculate("d", "c * 10"), enrich.Calculate("a", "d")])
    assert out.select("a", "c", "d").first() == (30, 3, 30)


@pytest.mark.parametrize("ranges,ages,labels", [
    ([[0, 18], [19, 35], [36, 55], [56, 150]], [25, 55, 75, 18.5], ["young_adult", "adult", "senior", None]),
    ([[0, 18], [18, 35], [35, 55], [55, 150]], [10, 25, 45, 70, None, 18, 200, -1],
     ["minor", "young_adult", "adult", "senior", None, "minor", "senior", None])])
def test_category_map(spark, ranges, ages, labels):
    df = frame(spark, [(i, None if a is None else float(a)) for i, a in enumerate(ages)], "i int, age double")
    rule = enrich.CategoryMap("group", "age", ranges, ["minor", "young_adult", "adult", "senior"])
    assert [r["group"] for r in rule.apply(df).orderBy("i").collect()] == labels


def test_conditional(spark):
    df = frame(spark, [(1, 150), (2, 50), (3, None)], "i int, price int")
    out = enrich.Conditional("tier", "price > 100", "premium", "standard").apply(df).orderBy("i")
    assert [r["tier"] for r in out.collect()] == ["premium", "standard", "standard"]


def test_date_parts(spark):
    df = frame(spark, [("2024-02-29T10:11:12",), ("",), (None,)], "d string")
    out = df.select(*[dates.date_part(F.col("d"), "string", p).alias(p) for p in
                      ("year", "dayofweek", "quarter", "dayofyear", "is_leap_year", "is_month_end", "days_in_month", "nothing")]).collect()
    assert tuple(out[0]) == (2024, 3, 1, 60, True, True, 29, None) and tuple(out[1]) == (None,) * 8 == tuple(out[2])


def test_filter_drops_null_and_false(spark):
    df = frame(spark, [(1, 5), (2, None), (3, 50)], "i int, v int")
    assert rows(filters.filter_rows(df, "v > 10"), "i") == [(3,)]
    assert filters.filter_rows(df, None).count() == 3


def test_config_validation(spark):
    df = frame(spark, [(1, 100), (2, -10)], "id int, price int")
    out = run(df, {"validation": [{"type": "required", "field": "id"}, {"type": "range", "field": "price", "min": 0}]})
    assert out.summary.first() == (False, 1, 0) and out.records.count() == 2
    assert rows(out.errors, "id", "field", "message") == [(2, "price", "price below minimum: 0")]


def test_config_enrich_then_aggregate(spark):
    df = frame(spark, [("A", 100), ("A", 200), ("B", 150)], "category string, value int")
    out = run(df, {"enrichment": [{"type": "calculate", "target": "total", "expression": "value"}],
                   "aggregation": {"group_by": ["category"], "aggregations": {"s": "sum,total", "n": "count", "x": "nothing,value"}}})
    assert rows(out.records, "category", "s", "n", "x") == [("A", 300, 2, None), ("B", 150, 1, None)]
    assert out.steps_completed == ["enrichment", "aggregation"]


def test_empty_input_and_config(spark):
    df = frame(spark, [], "id int, v int")
    assert run(df, {}).records.count() == 0
    assert aggregate.aggregate(df, [], {"n": "count"}).count() == 0
    assert validate.validate(df, [validate.Required("id")]).first() == (True, 0, 0)


def test_aggregate_edge_cases(spark):
    df = frame(spark, [(1, "a", None), (2, "a", 4), (3, None, None), (4, None, None), (5, "b", 7)], "id int, g string, v int")
    spec = {"s": "sum,v", "m": "mean,v", "sd": "std,v", "md": "median,v", "lo": "min,v", "f": "first,v", "l": "last,v", "mode": "mode,v"}
    out = aggregate.aggregate(df, ["g"], spec, "id")
    assert rows(out, "g", *spec) == [("a", 4, 4.0, 0.0, 4.0, 4, None, 4, 4), ("b", 7, 7.0, 0.0, 7.0, 7, 7, 7, 7),
                                     (None, 0, 0.0, 0.0, 0.0, None, None, None, None)]


def test_mode_takes_the_first_seen_of_equals(spark):
    df = frame(spark, [(1, "g", "z"), (2, "g", "a"), (3, "g", "a"), (4, "g", "z")], "id int, k string, v string")
    assert rows(aggregate.aggregate(df, ["k"], {"m": "mode,v"}, "id")) == [("g", "z")]


def test_scaling(spark):
    df = frame(spark, [(1, 0), (2, 50), (3, 100), (4, None)], "id int, price int")
    assert rows(scaling.normalize(df, ["price"]), "id", "price_normalized") == [(1, 0.0), (2, 0.5), (3, 1.0), (4, None)]
    flat = frame(spark, [(1, 5), (2, 5)], "id int, v int")
    for method, value in (("min_max", 0.5), ("z_score", 0.0), ("robust", 0.0)):
        assert {r["v_normalized"] for r in scaling.normalize(flat, ["v"], method).collect()} == {value}
    fixed = scaling.normalize(df, ["price"], bounds={"price": (0, 200)})
    assert rows(fixed, "id", "price_normalized")[2] == (3, 0.5)
    text_only = frame(spark, [("a",)], "name string")
    assert scaling.normalize(text_only, ["name", "absent"]).columns == ["name"]


def test_encoding(spark):
    df = frame(spark, [(1, "active"), (2, "pending"), (3, "active"), (4, None)], "id int, status string")
    assert rows(encoding.label_encode(df, "status"), "id", "status_encoded") == [(1, 1), (2, 2), (3, 1), (4, 0)]
    hot = encoding.encode(df, "status", "one_hot")
    assert rows(hot, "id", "status_active", "status_pending") == [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 0)]
    assert encoding.encode(df, "status", "unknown").columns == df.columns


def test_pivot_last_record_wins(spark):
    df = frame(spark, [(1, "x", "a", 1), (2, "x", "a", 2), (3, "x", None, 3), (4, "y", "b", 4), (5, "y", "b", None)],
               "id int, i string, c string, v int")
    out = transform(df, "pivot", {"index": "i", "columns": "c", "values": "v"}, "id")
    assert rows(out, "i", "a", "b", "null") == [("x", 2, None, 3), ("y", None, None, None)]


def test_flatten(spark):
    df = spark.sql("""select 'Acme' company, array(named_struct('name', 'R&D', 'staff', array(named_struct('role', 'eng'), named_struct('role', 'qa'))),
        named_struct('name', 'Ops', 'staff', cast(array() as array<struct<role: string>>))) departments""")
    assert names.data_category(df.schema) == "complex"
    assert rows(reshape.flatten(df)) == [("Acme", "Ops", None), ("Acme", "R&D", "eng"), ("Acme", "R&D", "qa")]


def test_rules(spark):
    df = frame(spark, [(1, "", "active", "5"), (2, "n", "unknown", "x")], "id int, name string, status string, amount string")
    rules = [validate.Required("name"), validate.Enum("status", ("active",)), validate.Range("amount", 10, None),
             validate.Pattern("name", "[a-m]"), validate.Type("amount", "int"), validate.Custom("id", lambda c: c < 2)]
    out = rows(validate.error_rows(df, rules, ["id"]), "id", "rule")
    assert out == [(1, "pattern_name"), (1, "range_amount"), (1, "required_name"),
                   (2, "custom_id"), (2, "enum_status"), (2, "pattern_name"), (2, "type_amount")]
    assert len(validate.without_rule(rules, "required_name")) == 5


def test_noise_cascade(spark):
    near = [10.0, 11.0, 10.5, 9.5, 10.2, 9.8]
    df = frame(spark, [(i, v) for i, v in enumerate([*near, 13.0])], "id int, v double")
    tests = noise.outlier_tests(df)
    assert [(t.field, t.method) for t in tests if t.field == "v"] == [("v", "mad")]
    assert rows(df.where(tests[-1].flag()), "v") == [(13.0,)]
    few = frame(spark, [(1, 1.0), (2, 1.1), (3, 0.9), (4, 1.0), (5, 90.0)], "id int, v double")
    assert [t.threshold for t in noise.zscore_tests(few, ["v"])] == [1.5]


def test_noise_labels_and_cleaning(spark):
    df = frame(spark, [(1, "a", "x@y.z"), (2, "  ", "p@q.r"), (3, "a", None)], "id int, name string, mail string")
    labels = noise.noise_labels(df, "id")
    assert rows(labels, "id", "field", "noise_type", "suggested_action") == [
        (2, "name", "missing_value", "impute or remove"), (3, "mail", "missing_value", "impute or remove"),
        (3, "name", "duplicate", "deduplicate")]
    assert rows(noise.clean(df, labels, "id"), "id") == [(1,)]
    assert noise.clean(df, labels, "id", remove_labeled=False).count() == 3
    assert noise.suggested_action("odd") == "review manually"


def test_sampling_falls_back_to_random(spark):
    out = sampling.sample(spark.range(100), 10, "id", "nonexistent_strategy").collect()
    assert len(out) == 10 and {r["_sample_strategy"] for r in out} == {"random"}
    assert sorted(r["_sample_index"] for r in out) == list(range(10))
    assert sampling.sample(spark.range(5), 10, "id").count() == 5
    assert sampling.confidence_size(10**6, 0.05) == 385 and sampling.fraction_size(50, 0.05) == 3


def test_profile_of_long_text(spark):
    long = "https://example.org/" + "a" * 300
    df = frame(spark, [(long,), (long + "b",), (long,)], "url string")
    out = profile.field_profiles(df).first()
    assert (out["type"], out["pattern"], out["cardinality"], out["unique"], out["max_length"]) == ("string", "url", 2, False, 321)
    assert profile.dataset_statistics(df).first() == (3, 1, 1)


@pytest.mark.parametrize("target,low,high,wanted", [
    ("mysql", 0, 200, "TINYINT UNSIGNED"), ("mysql", -5, 200, "SMALLINT"), ("mysql", -5, 100, "TINYINT"),
    ("postgresql", 0, 40000, "INTEGER"), ("sqlserver", -1, 2**31, "BIGINT"), ("sqlite", 0, 2**40, "INTEGER")])
def test_integer_types_hold_both_bounds(spark, target, low, high, wanted):
    assert spark.range(1).select(profile.integer_type(F.lit(low), F.lit(high), target)).first()[0] == wanted


def test_classification(spark):
    kinds = lambda lines: classify.category(
        frame(spark, list(enumerate(lines)), "id int, line string"), "line", "id").first()["category"]
    assert kinds(['{"a":1,"b":2}', '{"b":3,"a":null}']) == "certain"
    assert kinds(['{"a":1,"b":2}', '{"a":1}']) == "mixed"
    assert kinds(['{"a":1}', '{"b":1}']) == "ambiguous"
    assert kinds(['{"a":1}', '[1]']) == "ambiguous" == kinds([])


def test_text_functions(spark):
    cases = ["x ```json\n{\"a\": 1}\n``` y", '{"a": 1}', 'so: {"a": 1} done', 'list [1, 2] {"a": 1} end', "nothing", '```\n[1]\n```']
    df = frame(spark, list(enumerate(cases)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.json_in_text(F.col("t"))).collect()]
    assert [g and g.strip() for g in got] == ['{"a": 1}', '{"a": 1}', '{"a": 1}', "[1, 2]", None, "[1]"]
    answer = [r[0] for r in df.orderBy("i").select(text.json_in_answer(F.col("t"))).collect()]
    assert answer == ['{"a": 1}', '{"a": 1}', '{"a": 1}', "[1, 2]", None, "[1]"]
    flags = frame(spark, [("2024-1-5",), ("31/12/2024",), ("11:59 pm",), ("24:00",), ("2024-02-30",)], "t string").select(
        text.is_datetime_text(F.col("t")), text.is_date_text(F.col("t")), text.is_time_text(F.col("t"))).collect()
    assert [tuple(r) for r in flags] == [(True, True, False), (False, True, False), (False, False, True), (False,) * 3, (False,) * 3]


def test_names(spark):
    assert [names.snake_key(n) for n in ("userName", "HTTPServer", "a--b", "Ünit É")] == ["user_name", "httpserver", "a_b", "ünit_é"]
    assert [names.snake_field(n) for n in ("userID", "HTTPServer", "plain")] == ["user_id", "http_server", "plain"]
    df = spark.sql("select 1 as `aB`, 2 as `a_b`")
    assert names.normalize_names(df).collect() == [(2,)]
    assert names.schema_hash([]) == ""


def test_change_rows_and_polling(spark):
    old = frame(spark, [(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = frame(spark, [(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    assert rows(setops.change_rows(old, new, "id", "t"), "operation", "id") == [("DELETE", 3), ("INSERT", 4), ("UPDATE", 2)]
    assert setops.poll_result(new, new).count() == 0 and setops.poll_result(None, new).count() == 3


def test_merge_lookup_null_overwrites(spark):
    df = frame(spark, [(1, "old"), (2, "old")], "k int, v string")
    side = frame(spark, [(1, None, "x")], "id int, v string, w string")
    assert rows(joins.merge_lookup(df, side, "k", "id"), "k", "v", "w") == [(1, None, "x"), (2, "old", None)]


def test_action_chain(spark):
    df = frame(spark, [(1, "valid"), (2, "error")], "i int, item string")

    def act(value):
        if value == "error":
            raise ValueError("boom")
        return value.upper()

    out = batch.run_actions(df, "item", [act])
    assert rows(out, "i", "output", "error", "processed") == [(1, "VALID", None, True), (2, None, "boom", True)]
    assert batch.tally(out).first() == (2, 1, 1)
