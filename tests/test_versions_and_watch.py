"""Versions of tables, loads of receipts, watching a folder, joins with frequent keys."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rowmill.operators import documents, joins
from rowmill.operators.enrich import Rule, enrich
from rowmill.plans.value_add import transform
from rowmill.sources import receipts
from rowmill.sources.folders import folder_exists
from rowmill.sources.tables import TableStore
from rowmill.streaming.watch import DirectoryWatch
from tests.conftest import plan_of, rows


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def fresh_name():
    return f"t_{uuid.uuid4().hex}"


def test_overwrite_with_other_columns_keeps_the_table_and_the_version_before(spark, store):
    name = fresh_name()
    store.overwrite(name, spark.sql("select 1 id, 'a' name"))
    before = store.load(name)
    store.overwrite(name, spark.sql("select 2.5 price"))
    assert store.load(name).columns == ["price"] and rows(store.load(name, number=1)) == [(1, "a")]
    assert rows(before) == [(1, "a")]  # a reader that began earlier
    store.store(name, spark.sql("select 3.5 price, 'x' unknown"))
    assert [float(r[0]) for r in rows(store.load(name))] == [2.5, 3.5]


def test_a_write_that_fails_changes_nothing(spark, store):
    name = fresh_name()
    store.overwrite(name, spark.sql("select 1 id"))
    with pytest.raises(Exception, match="broken"):
        store.overwrite(name, spark.range(3).select(F.raise_error(F.lit("broken")).alias("other")))
    assert rows(store.load(name)) == [(1,)] and [v["number"] for v in store.history(name)] == [1]


def test_folders_of_old_versions_are_removed(spark, store):
    name = fresh_name()
    folders = []
    for i in range(4):
        store.overwrite(name, spark.sql(f"select {i} id"))
        folders.append(store.history(name)[0]["folder"])
    assert store.update(name, {"id": 3}, {"id": 9}) == 1
    assert [v["number"] for v in store.history(name)] == [5, 4]
    assert [folder_exists(spark, f) for f in folders] == [False, False, False, True]
    assert spark.sql(f"show tables like '{name}__*'").count() == 2
    with pytest.raises(ValueError, match="not kept"):
        store.load(name, number=1)
    store.drop(name)
    assert not store.exists(name) and not folder_exists(spark, folders[3])
    store.drop(name)


def test_a_table_of_others_is_not_replaced(spark, store):
    name = fresh_name()
    spark.sql("select 1 id").write.saveAsTable(name)
    store.store(name, spark.sql("select 2 id"))
    assert rows(store.load(name)) == [(1,), (2,)]
    with pytest.raises(ValueError, match="not made by"):
        store.overwrite(name, spark.sql("select 3 id"))
    spark.sql(f"drop table {name}")


def test_the_first_of_equal_new_keys_is_stored(spark, store):
    name = fresh_name()
    store.store_new(name, spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "id int, name string, at int"), ["id"], order_by="at")
    assert rows(store.load(name)) == [(1, "b", 1)]


def parsed(spark, *arrived):
    text = lambda shop: json.dumps({"merchant": {"name": shop}, "items": [{"description": shop}], "summary": {"tax_breakdown": []}})
    df = spark.createDataFrame([(i, number, text(shop)) for i, (number, shop) in enumerate(arrived)], "at int, number string, raw string")
    return documents.parse_documents(df, "number", "raw", keep=("at",))


def test_the_receipt_that_arrived_first_is_stored(spark, store):
    prefix = fresh_name()
    receipts.insert_receipts(store, parsed(spark, ("n", "zebra"), ("n", "apple"), ("m", "kiwi")), prefix, order_by="at")
    receipts.insert_receipts(store, parsed(spark, ("n", "late"), ("o", "fig")), prefix, order_by="at")
    assert rows(store.load(prefix + "receipts"), "receipt_number", "merchant_name") == [("m", "kiwi"), ("n", "zebra"), ("o", "fig")]
    assert store.load(prefix + "receipt_items").count() == 3


def test_a_batch_is_loaded_once(spark, store):
    prefix = fresh_name()
    assert receipts.insert_receipts(store, parsed(spark, ("n", "a")), prefix, batch_id="x").count() == 1
    assert receipts.insert_receipts(store, parsed(spark, ("m", "b")), prefix, batch_id="x").count() == 0
    assert receipts.insert_receipts(store, parsed(spark, ("m", "b")), prefix, batch_id="y").count() == 1
    assert receipts.insert_receipts(store, parsed(spark), prefix, batch_id="z").count() == 0


@pytest.mark.parametrize("stored_before", [False, True])
def test_a_load_that_ended_early_is_made_good(spark, store, monkeypatch, stored_before):
    prefix = fresh_name()
    if stored_before:
        receipts.insert_receipts(store, parsed(spark, ("k", "old")), prefix)
    monkeypatch.setattr(receipts, "shred_taxes", lambda df: df.select(F.raise_error(F.lit("lost")).alias("x")))
    with pytest.raises(Exception, match="lost"):
        receipts.insert_receipts(store, parsed(spark, ("n", "a")), prefix, batch_id="x")
    monkeypatch.undo()
    assert receipts.insert_receipts(store, parsed(spark, ("n", "a")), prefix, batch_id="x").count() == 1
    items = rows(store.load(prefix + "receipt_items"), "receipt_number")
    assert items == ([("k",)] if stored_before else []) + [("n",)]


def test_a_load_reads_only_the_numbers_near_its_own(spark, store):
    name = fresh_name()
    store.store(name, spark.range(1000).selectExpr("concat('r', id) receipt_number", "id other"))
    fresh = spark.sql("select explode(array('r5', 'r7', 'rx')) receipt_number")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    found = receipts.stored_numbers(store, name, fresh)
    assert rows(found) == [("r5",), ("r7",)]
    plan = plan_of(found)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(receipt_number,r5)" in plan and "LessThanOrEqual(receipt_number,rx)" in plan
    assert "ReadSchema: struct<receipt_number:string>" in plan and "SortMergeJoin" not in plan


def seen(df):
    return sorted((r["type"], os.path.basename(r["path"])) for r in df.collect())


def test_watch_reports_new_changed_and_missing_files_over_restarts(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / name).write_text(name)
    assert seen(DirectoryWatch(spark, str(folder), state).poll()) == [("created", "a"), ("created", "b"), ("created", "c")]
    (folder / "b").write_text("longer")
    os.utime(folder / "b", (2_000_000_000, 2_000_000_000))
    (folder / "c").unlink()
    (folder / "d").write_text("d")
    watch = DirectoryWatch(spark, str(folder), state)
    assert seen(watch.poll()) == [("created", "d"), ("deleted", "c"), ("modified", "b")]
    assert seen(watch.poll()) == [] and watch.last_poll() == 3
    assert sorted(r[0] for r in watch.events().select("poll").collect()) == [1, 1, 1, 2, 2, 2]
    assert not folder_exists(spark, f"{state}/listings/poll=1")


def test_watch_makes_an_unfinished_poll_again(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a").write_text("a")
    watch = DirectoryWatch(spark, str(folder), state)
    watch.poll()
    spark.sql("select 'created' type, 'lost' path, 1L size, current_timestamp() timestamp").write.parquet(f"{state}/events/poll=2")
    assert seen(watch.events()) == [("created", "a")]
    (folder / "b").write_text("b")
    assert seen(watch.poll()) == [("created", "b")] and seen(watch.events()) == [("created", "a"), ("created", "b")]


@pytest.fixture
def skewed(spark):
    return spark.range(3000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('k', id)) key").repartition(5)


def test_only_frequent_keys_are_copied(spark, skewed):
    side = skewed.select("key").distinct().withColumn("x", F.length("key"))
    assert joins.hot_hashes(skewed, ["key"]) == [skewed.where("key = 'hot'").select(F.xxhash64("key")).first()[0]]
    joined = joins.lookup_join(skewed, side, "key", small=False)
    assert joined.where(F.col("x").isNull()).count() == 0 and joined.count() == 3000
    plan = plan_of(joined)
    assert plan.count("CASE WHEN (xxhash64") == 2  # one salt on the left, copies of one key on the right
    assert "_salt" not in plan_of(joins.lookup_join(spark.range(1000).selectExpr("concat('k', id) key"), side, "key", small=False))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_zeros_and_nulls_meet_under_salt(spark, how):
    left = spark.range(400).selectExpr("id", "case id % 4 when 0 then -0.0D when 1 then 0.0D when 2 then double('NaN') end key").repartition(7)
    right = spark.sql("select explode(array(-0.0D, double('NaN'), null)) key, 1 one")
    both = [repr(rows(joins.lookup_join(left, right, "key", how, True, small))) for small in (False, True)]
    assert both[0] == both[1] and joins.hot_hashes(left, ["key"])


def test_a_stream_joins_without_being_counted(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    joined = joins.lookup_join(stream, spark.range(5).withColumn("x", F.lit(1)), "id", small=False)
    joined.writeStream.format("memory").queryName("joined_rows").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("joined_rows").where("x = 1").count() == 5


def test_a_rule_of_ones_own_and_the_aggregate_step(spark):
    class Initial(Rule):
        def apply(self, df):
            return df.withColumn(self.target, F.substring("name", 1, 1))

    df = spark.createDataFrame([("ann", 1), ("al", 2), ("bo", 3), (None, 4)], "name string, n int")
    assert rows(enrich(df, [Initial("first")]), "first", "n") == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    found = transform(enrich(df, [Initial("first")]), "aggregate", {"group_by": ["first"], "aggregations": {"total": "sum,n"}}, "n")
    assert rows(found, "first", "total") == [("a", 3), ("b", 3), (None, 4)]


def test_of_repeated_keys_of_a_source_one_row_is_sure(spark):
    source = spark.sql("select * from values (1, 'b', 1), (1, 'a', 2), (1, null, 3), (null, 'z', 4) t(k, name, at)").repartition(4)
    df = spark.sql("select explode(array(1, 2, null)) k")
    assert rows(joins.lookup_field(df, "name", source, "k")) == [(1, "a"), (2, None), (None, None)]
    assert rows(joins.lookup_field(df, "name", source, "k", order_by=F.col("at").desc())) == [(1, None), (2, None), (None, None)]
    assert rows(joins.merge_lookup(df, source, "k", "k"), "k", "at") == [(1, 2), (2, None), (None, None)]
    assert rows(joins.merge_lookup(df, source, "k", "k", "at"), "k", "name") == [(1, "b"), (2, None), (None, None)]
