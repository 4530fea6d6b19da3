"""The paths for frequent keys and large inputs, run on small tables by lowering the bounds."""

import statistics

import pytest
from pyspark.sql import functions as F

from rowmill.operators import aggregate, documents, encoding, groups, joins, noise, renew, reshape, sampling, scaling
from rowmill.operators.index import global_index
from tests.conftest import rows


@pytest.fixture
def skewed(spark):
    """3,000 rows; one key holds half of them, and values repeat."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        (F.pmod(F.hash("id"), F.lit(997)) / 10).alias("value")).repartition(5)


def by_key(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        found.setdefault(r["key"], []).append(r)
    return found


def test_global_index(skewed):
    got = rows(global_index(skewed, ["value", "id"]), "row_index", "id")
    wanted = sorted(skewed.collect(), key=lambda r: (r["value"], r["id"]))
    assert got == sorted(((i, r["id"]) for i, r in enumerate(wanted)), key=repr)


@pytest.mark.parametrize("bound", [100, 10**6])
def test_median_per_group(skewed, monkeypatch, bound):
    monkeypatch.setattr(groups, "GROUP_ROWS", bound)
    monkeypatch.setattr(groups, "RANKED_ROWS", bound)
    out = aggregate.aggregate(skewed, ["key"], {"mid": "median,value", "n": "count"})
    for r in out.collect():
        values = [x["value"] for x in by_key(skewed)[r["key"]]]
        assert r["mid"] == pytest.approx(statistics.median(values)) and r["n"] == len(values)


def test_positions_in_a_large_group(skewed, monkeypatch):
    monkeypatch.setattr(groups, "RANKED_ROWS", 100)
    picks = {f"p{i}": lambda n, i=i: F.floor((n - 1) * i / 10) for i in range(11)}
    for r in groups.order_statistics(skewed, ["key"], "value", picks).collect():
        values = sorted(x["value"] for x in by_key(skewed)[r["key"]])
        assert [r[f"p{i}"] for i in range(11)] == [values[(len(values) - 1) * i // 10] for i in range(11)]


def test_positions_need_no_sketch_and_no_whole_group(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, null, 'k') key", "id % 7 value")
    found = groups.order_statistics(df, ["key"], "value", {"low": lambda n: n * 0, "high": lambda n: n - 1, "none": lambda n: n})
    assert {r["key"]: (r["n"], r["low"], r["high"], r["none"]) for r in found.collect()} == {None: (667, 0, 6, None), "k": (1333, 0, 6, None)}
    plan = found._jdf.queryExecution().toString()
    assert "percentile" not in plan and "raise_error" not in plan and "rangepartitioning" not in plan  # ranges are laid out once, before


@pytest.mark.parametrize("bound", [40, 10**6])
def test_lists_are_whole(skewed, bound):
    out = groups.collect_parts(skewed, ["key"], "id", {"id": F.col("id")}, max_items=bound)
    parts = {}
    for r in sorted(out.collect(), key=lambda r: r["part"]):
        assert len(r["items"]) <= bound
        parts.setdefault(r["key"], []).extend(x["id"] for x in r["items"])
    assert parts == {k: [x["id"] for x in v] for k, v in by_key(skewed).items()}


def test_list_output_continues_in_parts(skewed):
    out = aggregate.aggregate(skewed, ["key"], {"n": "count", "ids": "list,id", "vs": "list,value"}, "id", max_items=200).collect()
    hot = sorted((r for r in out if r["key"] == "hot"), key=lambda r: r["part"])
    assert len(hot) > 1 and [x for r in hot for x in r["ids"]] == list(range(0, 3000, 2))
    assert all(len(r["ids"]) == len(r["vs"]) for r in out)


def test_nest_parts(skewed):
    out = reshape.nest(skewed, "key", ["id"], "id", max_items=100).where("key = 'hot'").orderBy("part").collect()
    assert [x["id"] for r in out for x in r["items"]] == list(range(0, 3000, 2))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(skewed, how, null_safe):
    side = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key is null or key in ('hot', 'k3', 'k5')")
    salted = joins.lookup_join(skewed, side, "key", how, null_safe, small=False)
    assert rows(salted) == rows(joins.lookup_join(skewed, side, "key", how, null_safe, small=True))


@pytest.mark.parametrize("size", [5, 700, 2990, 5000])
def test_large_random_sample_equals_small(skewed, monkeypatch, size):
    wanted = rows(sampling.random_sample(skewed, size, "id"))
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 0)
    assert rows(sampling.random_sample(skewed, size, "id")) == wanted


@pytest.mark.parametrize("spread", [None, 0.0])
def test_stratified_quotas_are_exact(skewed, monkeypatch, spread):
    if spread is not None:  # limits so tight that they miss, so whole groups are ranked
        monkeypatch.setattr(sampling, "_spread", lambda quota: F.lit(spread))
    out = sampling.stratified_sample(skewed, 400, "id", "key").collect()
    import hashlib
    digest = lambda r: (hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["id"])
    for key, members in by_key(skewed).items():
        quota = max(1, round(400 * (len(members) / 3000)))
        wanted = sorted(members, key=digest)[:quota]
        assert sorted(r["id"] for r in out if r["key"] == key) == sorted(r["id"] for r in wanted)
    assert sorted(r["_sample_index"] for r in out) == list(range(len(out)))


def test_custom_sample_beyond_the_small_bound(skewed, monkeypatch):
    wanted = rows(sampling.custom_sample(skewed, 900, "id", "value > 20"))
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 10)
    assert rows(sampling.custom_sample(skewed, 900, "id", "value > 20")) == wanted


def test_label_codes_of_many_values(skewed, monkeypatch):
    wanted = rows(encoding.label_encode(skewed, "key"))
    monkeypatch.setattr(encoding, "MAX_CATEGORIES", 3)
    assert rows(encoding.label_encode(skewed, "key")) == wanted


def test_many_categories_have_a_row_form(skewed, monkeypatch):
    monkeypatch.setattr(encoding.categories, "__defaults__", (3,))
    with pytest.raises(ValueError, match="one_hot_long"):
        encoding.one_hot_encode(skewed, "key")
    with pytest.raises(ValueError, match="pivot_long"):
        reshape.pivot(skewed, "id", "key", "value", "id")
    assert encoding.one_hot_long(skewed, ["id"], "key").count() == skewed.where("key is not null").count()


def test_robust_scaling_of_a_large_column(skewed, monkeypatch):
    wanted = rows(scaling.normalize(skewed, ["value"], "robust"))
    monkeypatch.setattr(groups, "RANKED_ROWS", 100)
    assert rows(scaling.normalize(skewed, ["value"], "robust")) == wanted


def test_outlier_statistics_of_a_large_column(skewed, monkeypatch):
    wanted = noise.mad_tests(skewed, ["value"]), noise.iqr_tests(skewed, ["value"])
    monkeypatch.setattr(groups, "RANKED_ROWS", 100)
    assert (noise.mad_tests(skewed, ["value"]), noise.iqr_tests(skewed, ["value"])) == wanted


def test_versions_of_a_frequent_key(skewed, monkeypatch):
    wanted = rows(renew.versions(skewed, "key", "id"))
    monkeypatch.setattr(groups, "RANKED_ROWS", 100)
    assert rows(renew.versions(skewed, "key", "id")) == wanted


def test_duplicates_with_a_frequent_value(skewed):
    out = noise.field_duplicates(skewed, ["key"], "id").collect()
    wanted = [r["id"] for key, members in by_key(skewed).items() if key is not None for r in members[1:]]
    assert sorted(r["id"] for r in out) == sorted(wanted)


def test_large_receipts_continue_in_parts(spark):
    headers = spark.sql("""select receipt_number, 'm' merchant_name, '' merchant_address, '' merchant_phone, '' merchant_tax_id,
        date'2024-01-01' transaction_date, '' transaction_time, '' clerk, 1 subtotal, 1 tax_amount, 1 total_amount, '' payment_method,
        1 amount_tendered, 1 change_due from values ('a'), ('b'), ('c') t(receipt_number)""")
    items = spark.range(25).selectExpr("if(id < 20, 'a', 'b') receipt_number", "id line", "cast(id as string) description",
                                       "1 quantity", "1 unit_price", "1 line_total")
    taxes = spark.range(3).selectExpr("'c' receipt_number", "id line", "'t' tax_type", "1 tax_rate", "1 tax_amount")
    out = documents.assemble(headers, items, taxes, max_items=8).orderBy("receipt_number", "part").collect()
    lines = lambda n: [x["description"] for r in out if r["receipt_number"] == n for x in r["items"]]
    assert lines("a") == [str(i) for i in range(20)] and lines("b") == [str(i) for i in range(20, 25)] and lines("c") == []
    assert [len(r["tax_breakdown"]) for r in out if r["receipt_number"] == "c"] == [3]
