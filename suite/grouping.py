"""Aggregation queries (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import aggregate as agg
from rowmill.operators.joins import first_per_key
from suite.registry import LINE_KEY, query, table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("discount", F.expr("nullif(l_discount, 0)"))


def _events(spark, sf_dir):
    """Events whose error type is absent."""
    return table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))


_E = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"
_L = "(SELECT *, nullif(l_discount, 0) AS discount FROM lineitem)"


@query("agg_sum", f"""SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_quantity), 0), 2) AS sum_qty,
round(coalesce(sum(discount), 0), 2) AS sum_discount, CAST(0.0 AS DOUBLE) AS sum_nothing FROM {_L} GROUP BY ALL""")
def agg_sum(spark, sf_dir):
    out = agg.aggregate(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus"],
                        {"sum_qty": "sum,l_quantity", "sum_discount": "sum,discount", "sum_nothing": "sum"})
    return out.withColumns({c: F.round(c, 2) for c in ("sum_qty", "sum_discount")})


@query("agg_count", f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM {_E} GROUP BY ALL")
def agg_count(spark, sf_dir):
    return agg.aggregate(_events(spark, sf_dir), ["kind"], {"n": "count"})


@query("agg_mean", f"""SELECT l_linenumber, round(coalesce(avg(discount), 0), 6) AS avg_discount,
round(coalesce(avg(l_extendedprice), 0), 4) AS avg_price FROM {_L} GROUP BY ALL""")
def agg_mean(spark, sf_dir):
    out = agg.aggregate(_lines(spark, sf_dir), ["l_linenumber"],
                        {"avg_discount": "mean,discount", "avg_price": "avg,l_extendedprice"})
    return out.withColumns({"avg_discount": F.round("avg_discount", 6), "avg_price": F.round("avg_price", 4)})


@query("agg_min_max", f"""SELECT user_id, min(value) AS low, max(value) AS high, min(kind) AS first_kind,
max(kind) AS last_kind FROM {_E} GROUP BY ALL""")
def agg_min_max(spark, sf_dir):
    return agg.aggregate(_events(spark, sf_dir), ["user_id"],
                         {"low": "min,value", "high": "max,value", "first_kind": "min,kind", "last_kind": "max,kind"})


@query("agg_std", """SELECT l_suppkey, round(coalesce(stddev_pop(l_extendedprice), 0), 4) AS std_price
FROM lineitem GROUP BY ALL""")
def agg_std(spark, sf_dir):
    out = agg.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"std_price": "std,l_extendedprice"})
    return out.withColumn("std_price", F.round("std_price", 4))


@query("agg_first_last", f"""SELECT user_id, arg_min_null(kind, event_id) AS first_kind,
arg_max_null(value, event_id) AS last_value FROM {_E} GROUP BY ALL""")
def agg_first_last(spark, sf_dir):
    return agg.aggregate(_events(spark, sf_dir), ["user_id"],
                         {"first_kind": "first,kind", "last_value": "last,value"}, order_by="event_id")


@query("agg_list", f"""SELECT user_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n,
string_agg(coalesce(kind, '-'), ',' ORDER BY event_id) AS kinds FROM {_E} GROUP BY ALL""")
def agg_list(spark, sf_dir):
    out = agg.aggregate(_events(spark, sf_dir), ["user_id"], {"n": "count", "kinds": "list,kind"}, order_by="event_id")
    return out.withColumn("kinds", F.array_join("kinds", ",", "-"))


@query("agg_median", f"""SELECT l_returnflag, round(coalesce(median(discount), 0), 6) AS mid_discount,
round(median(l_extendedprice), 4) AS mid_price FROM {_L} GROUP BY ALL""")
def agg_median(spark, sf_dir):
    out = agg.aggregate(_lines(spark, sf_dir), ["l_returnflag"],
                        {"mid_discount": "median,discount", "mid_price": "median,l_extendedprice"})
    return out.withColumns({"mid_discount": F.round("mid_discount", 6), "mid_price": F.round("mid_price", 4)})


@query("agg_mode", f"""
WITH c AS (SELECT user_id, kind, count(*) AS n, min(event_id) AS f FROM {_E} WHERE kind IS NOT NULL GROUP BY ALL),
r AS (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c)
SELECT u.user_id, r.kind AS top_kind FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN r ON r.user_id = u.user_id AND r.k = 1""")
def agg_mode(spark, sf_dir):
    return agg.aggregate(_events(spark, sf_dir), ["user_id"], {"top_kind": "mode,kind"}, order_by="event_id")


@query("agg_simple", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS result FROM orders GROUP BY ALL")
def agg_simple(spark, sf_dir):
    out = agg.aggregate_simple(table(spark, sf_dir, "orders"), "o_orderstatus", "mean", "o_totalprice")
    return out.withColumn("result", F.round("result", 4))


@query("agg_whole_table", """SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total
FROM orders HAVING count(*) > 0""")
def agg_whole_table(spark, sf_dir):
    out = agg.aggregate(table(spark, sf_dir, "orders"), [], {"n": "count", "total": "sum,o_totalprice"})
    return out.withColumn("total", F.round("total", 2))


@query("dedupe_first", """
SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def dedupe_first(spark, sf_dir):
    out = first_per_key(table(spark, sf_dir, "documents"), "text", "doc_id")
    return out.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("agg_count_by_line", """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n,
arg_min_null(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_extendedprice))::DATE::VARCHAR AS first_ship
FROM lineitem GROUP BY ALL""")
def agg_count_by_line(spark, sf_dir):
    out = agg.aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"],
                        {"n": "count", "first_ship": "first,l_shipdate"}, order_by=LINE_KEY)
    return out.withColumn("first_ship", F.date_format("first_ship", "yyyy-MM-dd"))
