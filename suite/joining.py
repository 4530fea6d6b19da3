"""Join and set queries (J, U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import joins, setops
from suite.registry import query, table


@query("enrich_lookup", """SELECT c_custkey, n_name AS nation FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON c_nationkey = n_nationkey""")
def enrich_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    out = joins.lookup_field(table(spark, sf_dir, "customer"), "nation", nations, "c_nationkey", "n_nationkey", "n_name")
    return out.select("c_custkey", "nation")


@query("enrich_lookup_merge", """
SELECT o_orderkey, CASE WHEN c.o_custkey IS NOT NULL THEN c.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
       c.c_name FROM orders o
LEFT JOIN (SELECT c_custkey AS o_custkey, nullif(c_acctbal, 0) AS o_totalprice, c_name FROM customer
           WHERE c_acctbal > 2000) c ON o.o_custkey = c.o_custkey""")
def enrich_lookup_merge(spark, sf_dir):
    source = table(spark, sf_dir, "customer").where("c_acctbal > 2000").select(
        "c_custkey", F.expr("nullif(c_acctbal, 0)").alias("o_totalprice"), "c_name")
    out = joins.merge_lookup(table(spark, sf_dir, "orders"), source, "o_custkey", "c_custkey")
    return out.select("o_orderkey", "o_totalprice", "c_name")


@query("join_left_anti", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def join_left_anti(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_in(table(spark, sf_dir, "customer"), stored, "c_custkey").select("c_custkey", "c_name")


@query("join_left_semi", """SELECT p_partkey, p_type FROM part WHERE p_partkey IN (
SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def join_left_semi(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.is_in(table(spark, sf_dir, "part"), known, "p_partkey").select("p_partkey", "p_type")


@query("join_range_bucket", """
WITH r AS (SELECT n_regionkey, CAST(min(n_nationkey) * 4000 AS DOUBLE) AS low,
                  CAST(max(n_nationkey) * 4000 AS DOUBLE) AS high, min(n_name) AS label FROM nation GROUP BY ALL)
SELECT o_orderkey, (SELECT arg_min(label, low) FROM r WHERE o_totalprice BETWEEN low AND high) AS band FROM orders""")
def join_range_bucket(spark, sf_dir):
    ranges = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        (F.min("n_nationkey") * 4000).cast("double").alias("low"),
        (F.max("n_nationkey") * 4000).cast("double").alias("high"), F.min("n_name").alias("label"))
    out = joins.assign_ranges(table(spark, sf_dir, "orders"), "o_totalprice", ranges, "low", "high", "label", "band")
    return out.select("o_orderkey", "band")


@query("join_range_wide", """
WITH r AS (SELECT l_extendedprice * 3 + k AS low, l_extendedprice * 3 + k + l_linenumber * 0.4 AS high,
                  l_orderkey * 10 + l_linenumber AS label FROM lineitem, (VALUES (0.0), (7.5)) AS v(k)),
found AS (SELECT o_orderkey, arg_min(label, {'a': low, 'b': high, 'c': label}) AS band FROM orders JOIN r ON o_totalprice >= low AND o_totalprice <= high GROUP BY 1)
SELECT o_orderkey, band FROM orders LEFT JOIN found USING (o_orderkey)""")
def join_range_wide(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.explode(F.array(F.lit(0.0), F.lit(7.5))))
    low = F.col("l_extendedprice") * 3 + F.col("k")
    ranges = lines.select(low.alias("low"), (low + F.col("l_linenumber") * 0.4).alias("high"),
                          (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"))
    out = joins.assign_ranges(table(spark, sf_dir, "orders"), "o_totalprice", ranges, "low", "high", "label", "band")
    return out.select("o_orderkey", "band")


@query("set_union_by_name", """
SELECT account, key, name, segment FROM (
  SELECT c_acctbal AS account, c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_acctbal, s_suppkey, s_name, NULL FROM supplier)""")
def set_union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("account"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("account"))
    return setops.union_by_name([customers, suppliers])


def _snapshots(spark, sf_dir):
    """The orders, and the orders after some were removed, added or repriced."""
    old = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    return old, new


_SNAPSHOTS = """
old AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT')"""


@query("snapshot_changed", f"WITH {_SNAPSHOTS} SELECT o_orderkey, o_totalprice FROM new")
def snapshot_changed(spark, sf_dir):
    return setops.poll_result(*_snapshots(spark, sf_dir)).select("o_orderkey", "o_totalprice")


@query("cdc_diff", f"""WITH {_SNAPSHOTS}
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN n.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       'orders' AS "table", coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
       coalesce(n.o_totalprice, o.o_totalprice) AS price
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice""")
def cdc_diff(spark, sf_dir):
    rows = setops.change_rows(*_snapshots(spark, sf_dir), "o_orderkey", "orders")
    return rows.select("operation", "table", "o_orderkey", F.col("data.o_totalprice").alias("price"))
