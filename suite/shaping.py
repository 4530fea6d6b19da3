"""Scaling, encoding and reshaping queries (X rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import encoding, reshape, scaling
from rowmill.plans.value_add import transform
from suite.registry import LINE_KEY, query, table

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _scaled(spark, sf_dir, fields, method):
    lines = table(spark, sf_dir, "lineitem").withColumn("discount", F.expr("nullif(l_discount, 0)"))
    out = scaling.normalize(lines, fields, method)
    return out.select(*LINE_KEY, *[F.round(f"{f}_normalized", 6).alias(f"{f}_normalized") for f in fields])


@query("norm_min_max", f"""SELECT {_KEY}, round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) /
(SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 6) AS l_quantity_normalized FROM lineitem""")
def norm_min_max(spark, sf_dir):
    return _scaled(spark, sf_dir, ["l_quantity"], "min_max")


@query("norm_z_score", f"""SELECT {_KEY}, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) /
(SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice_normalized FROM lineitem""")
def norm_z_score(spark, sf_dir):
    return _scaled(spark, sf_dir, ["l_extendedprice"], "z_score")


@query("norm_robust", f"""
WITH s AS (SELECT list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem),
t AS (SELECT v[n // 2 + 1] AS mid, v[n // 4 + 1] AS q1, v[(n // 4) * 3 + 1] AS q3 FROM s)
SELECT {_KEY}, round((l_extendedprice - mid) / (q3 - q1), 6) AS l_extendedprice_normalized FROM lineitem, t""")
def norm_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, ["l_extendedprice"], "robust")


@query("norm_multi", f"""
WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS b, min(nullif(l_discount, 0)) AS c,
                  max(nullif(l_discount, 0)) - min(nullif(l_discount, 0)) AS d FROM lineitem)
SELECT {_KEY}, round((l_quantity - a) / b, 6) AS l_quantity_normalized,
       round((nullif(l_discount, 0) - c) / d, 6) AS discount_normalized FROM lineitem, s""")
def norm_multi(spark, sf_dir):
    return _scaled(spark, sf_dir, ["l_quantity", "discount"], "something_else")


@query("encode_label", """
WITH v AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind NULLS FIRST) - 1 AS BIGINT) AS code
           FROM (SELECT DISTINCT nullif(event_type, 'error') AS kind FROM events))
SELECT event_id, code AS kind_encoded FROM events e JOIN v ON nullif(e.event_type, 'error') IS NOT DISTINCT FROM v.kind""")
def encode_label(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return encoding.label_encode(events, "kind").select("event_id", "kind_encoded")


@query("encode_one_hot", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def encode_one_hot(spark, sf_dir):
    out = encoding.one_hot_encode(table(spark, sf_dir, "orders"), "o_orderstatus")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderstatus_")])


@query("encode_target", """SELECT d.lang, round(avg(l.quality), 6) AS mean_target FROM documents d
JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def encode_target(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = encoding.target_means(labelled, "lang", "quality")
    return out.withColumn("mean_target", F.round("mean_target", 6))


@query("encode_target_join", """SELECT p_partkey, round(m, 4) AS p_type_encoded FROM part
JOIN (SELECT p_type AS t, avg(p_retailprice) AS m FROM part GROUP BY ALL) ON p_type = t""")
def encode_target_join(spark, sf_dir):
    out = encoding.encode(table(spark, sf_dir, "part"), "p_type", "target", "p_retailprice")
    return out.select("p_partkey", F.round("p_type_encoded", 4).alias("p_type_encoded"))


_CELLS = """SELECT user_id, coalesce(nullif(event_type, 'error'), 'null') AS kind, arg_max_null(value, event_id) AS v
FROM events GROUP BY ALL"""


@query("reshape_pivot", f"""SELECT user_id, max(v) FILTER (kind = 'click') AS click, max(v) FILTER (kind = 'purchase') AS purchase,
max(v) FILTER (kind = 'null') AS missing FROM ({_CELLS}) GROUP BY user_id""")
def reshape_pivot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    out = transform(events, "reshape", {"operation": "pivot", "index": "user_id", "columns": "kind", "values": "value"},
                    "event_id")
    have = set(out.columns)
    pick = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("double")
    return out.select("user_id", pick("click").alias("click"), pick("purchase").alias("purchase"),
                      pick("null").alias("missing"))


@query("reshape_pivot_long", f"SELECT user_id, kind, v AS value FROM ({_CELLS})")
def reshape_pivot_long(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("coalesce(nullif(event_type, 'error'), 'null')"))
    return reshape.pivot_long(events, "user_id", "kind", "value", "event_id")


@query("reshape_melt", """SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def reshape_melt(spark, sf_dir):
    return transform(table(spark, sf_dir, "part"), "melt",
                     {"id_vars": ["p_partkey", "absent"], "value_vars": ["p_size", "p_retailprice", "absent"]})


@query("reshape_nest", """SELECT conv_id AS key, CAST(0 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n,
string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS items FROM conversations GROUP BY conv_id""")
def reshape_nest(spark, sf_dir):
    out = reshape.nest(table(spark, sf_dir, "conversations"), "conv_id", ["role", "text"], "turn")
    joined = F.array_join(F.transform("items", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["text"]))), ",")
    return out.select("key", "part", F.size("items").cast("long").alias("n"), joined.alias("items"))


@query("transform_steps", """SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_encoded,
count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""")
def transform_steps(spark, sf_dir):
    """Steps by name, one after the other; a name that nothing knows changes nothing."""
    steps = [("filter", {"condition": "o_orderstatus <> 'P'"}), ("no_such_step", {"field": "o_orderstatus"}),
             ("aggregate", {"group_by": ["o_orderpriority"], "aggregations": {"n": "count", "total": "sum,o_totalprice"}}),
             ("encode", {"field": "o_orderpriority", "method": "label"})]
    rows = table(spark, sf_dir, "orders")
    for name, config in steps:
        rows = transform(rows, name, config, "o_orderkey")
    return rows.select("o_orderpriority", "o_orderpriority_encoded", "n", F.round("total", 2).alias("total"))
