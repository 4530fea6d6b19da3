"""Work that grows with the input: ranges in long bins, profiles of one large task, documents parsed for one table."""

import json
import random

from pyspark.sql import functions as F

from rowmill.functions.text import json_in_text, strip_fence
from rowmill.operators import documents, joins, profile
from rowmill.sources import receipts
from rowmill.sources.tables import TableStore
from tests.conftest import plan_of, rows


def test_long_bins_of_ranges_are_sorted_not_copied_to_each_value(spark, monkeypatch):
    monkeypatch.setattr(joins, "BIN_STRETCHES", 8)
    monkeypatch.setattr(joins, "MAX_BINS", 3)
    ranges = [(float(k), k + 0.5, k) for k in range(100)] + [(7.0, 7.5, None), (9.0, 9.5, 3)]
    df = spark.createDataFrame([(v / 4, "x.y") for v in range(-8, 420)] + [(50.25, "hot")] * 500 + [(None, "null"), (float("nan"), "nan")],
                               "v double, `a.b` string")
    found = joins.assign_ranges(df, "v", spark.createDataFrame(ranges, "low double, high double, label long"), "low", "high", "label", "band")
    plan = plan_of(found)
    assert "_stretches" not in plan and "Window" in plan
    band = lambda v: None if v is None or not 0 <= v < 100 or v % 1 > 0.5 or int(v) == 7 else 3 if int(v) == 9 else int(v)
    expected = [(str(v), t, band(v)) for v, t in [(r[0], r[1]) for r in df.collect()]]  # a NaN equals no other
    assert found.columns == ["v", "a.b", "band"] and sorted([(str(r[0]), r[1], r[2]) for r in found.collect()], key=repr) == sorted(expected, key=repr)


def test_a_profile_of_one_large_partition_is_dealt_over_tasks(spark):
    df = spark.range(1000, numPartitions=1).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"), F.lit("same").alias("b"))
    counted = profile.value_counts(df)
    assert plan_of(counted).count("Exchange") >= 2  # the scan's rows, then the values counted by each task
    assert {r["name"]: r["cardinality"] for r in profile.field_profiles(df).collect()} == {"a": 1000, "b": 1}


def test_each_table_parses_its_own_part_of_a_document(spark):
    odd = ['{"items": 5, "merchant": {"name": "m", "phone": 7}}', '{"merchant": "text", "items": [{"quantity": "2", "line_total": 3.5}]}',
           '{"summary": {"total_amount": "x", "tax_breakdown": [{"type": "VAT", "rate": 0.1}]}}', '{"items": [1, {"description": "d"}], "summary": []}',
           '[{"merchant": {"name": "listed"}, "items": [{"description": "l"}]}]', '{"merchant": {"name": "a"}, "merchant": {"name": "b"}}', "{}", "[]", "7", "cut {"]
    parsed = documents.parse_documents(spark.createDataFrame(list(enumerate(odd)), "n int, t string"), "n", "t")
    heads, items, taxes = documents.shred_headers(parsed), documents.shred_items(parsed), documents.shred_taxes(parsed)
    assert "tax_breakdown" not in plan_of(heads) and "merchant" not in plan_of(items) and "merchant" not in plan_of(taxes)
    whole = parsed.where("json is not null")
    assert rows(heads, "receipt_number", "merchant_name", "merchant_phone") == rows(whole.select("receipt_number", "doc.merchant.name", "doc.merchant.phone"))
    assert rows(items.select("receipt_number", "line", "description")) == rows(
        parsed.select("receipt_number", F.posexplode("doc.items").alias("line", "i")).select("receipt_number", "line", "i.description"))
    assert rows(taxes.select("receipt_number", "line", "tax_type")) == rows(
        parsed.select("receipt_number", F.posexplode("doc.summary.tax_breakdown").alias("line", "i")).select("receipt_number", "line", "i.type"))


def test_spans_and_fences_equal_a_plain_search(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["{", "}", "[", "]", '"a":', "1", ",", " ", "é", "　", "```", "json", "\n"]) for _ in range(rng.randrange(12))) for _ in range(600)]

    def valid(t):
        try:
            json.loads(t, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    def span(t):
        pairs = [(t.find(a), t.rfind(b)) for a, b in ("{}", "[]")]
        pairs = [p for p in pairs if p[0] >= 0 and p[1] > p[0]]
        return t[min(pairs)[0]:min(pairs)[1] + 1] if pairs else None

    def found(t):
        parts = t.split("```", 2)
        tries = [parts[1].removeprefix("json") if len(parts) == 3 else None, t, span(t)]
        return next((x for x in tries if x is not None and valid(x)), None)

    blanks = " \t\n　"

    def stripped(t):
        t = t.strip(blanks)
        t = t[7:] if t.startswith("```json") else t[3:] if t.startswith("```") else t
        return (t[:-3] if t.endswith("```") else t).strip(blanks)

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_in_text(F.col("t")).alias("j"), strip_fence(F.col("t")).alias("s"))
    assert "reverse(" not in plan_of(df)  # a copy of the text for each side
    for r in df.collect():
        assert (r["j"], r["s"]) == (found(r["t"]), stripped(r["t"])), r["t"]


def test_a_load_shuffles_json_but_not_the_raw_text(spark, monkeypatch):
    seen = []
    first = receipts.first_per_key
    monkeypatch.setattr(receipts, "first_per_key", lambda df, keys, order: seen.append(df.columns) or first(df, keys, order))
    texts = spark.createDataFrame([("a", '{"merchant": {"name": "m"}}', 1), ("a", '{"merchant": {"name": "n"}}', 0)], "n string, t string, at int")
    store = TableStore(spark)
    receipts.insert_receipts(store, documents.parse_documents(texts, "n", "t", keep=("at",)), "lean_", order_by="at")
    assert set(seen[0]) == {"receipt_number", "json", "at"}
    assert rows(store.load("lean_receipts"), "receipt_number", "merchant_name") == [("a", "n")]
