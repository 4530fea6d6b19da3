"""Projection, filter, enrichment and scalar queries (P, E, F rows)."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from rowmill.functions import names, text
from rowmill.operators import enrich, filters, reshape
from rowmill.operators.groups import collect_parts
from rowmill.operators.joins import lookup_join
from suite.registry import LINE_KEY, query, table


@query("filter_condition", """SELECT event_id, value FROM events
WHERE nullif(event_type, 'error') <> 'click' AND value > 20""")
def filter_condition(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return filters.filter_rows(events, "kind != 'click' and value > 20").select("event_id", "value")


@query("filter_zero_divisor", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_linenumber <> 1 AND (l_extendedprice / (l_linenumber - 1) > 20000 OR l_quantity = 5)""")
def filter_zero_divisor(spark, sf_dir):
    lines = filters.filter_rows(table(spark, sf_dir, "lineitem"), "l_extendedprice / (l_linenumber - 1) > 20000 or l_quantity = 5")
    return lines.select(*LINE_KEY)


@query("enrich_calculate", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
round(l_quantity * 2 + l_linenumber, 4) AS points FROM lineitem""")
def enrich_calculate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity_text", F.col("l_quantity").cast("string"))
    out = enrich.enrich(lines, [
        enrich.Calculate("charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
        enrich.Calculate("points", "quantity_text * 2 + l_linenumber")])
    return out.select(*LINE_KEY, F.round("charge", 6).alias("charge"), F.round("points", 4).alias("points"))


@query("enrich_date_extract", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q,
CAST((isodow(o_orderdate) - 1) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
CAST(NULL AS INTEGER) AS odd FROM orders""")
def enrich_date_extract(spark, sf_dir):
    parts = {"y": "year", "m": "month", "d": "day", "q": "quarter", "dow": "dayofweek", "doy": "dayofyear", "odd": "era"}
    orders = table(spark, sf_dir, "orders").withColumn("day_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = enrich.enrich(orders, [enrich.DatePart(k, "day_text" if k in ("y", "dow") else "o_orderdate", p)
                                 for k, p in parts.items()])
    return out.select("o_orderkey", *parts)


@query("enrich_date_shapes", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
CAST(day(o_orderdate) AS INTEGER) AS d FROM orders WHERE o_orderkey % 7 <> 6
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 6""")
def enrich_date_shapes(spark, sf_dir):
    """Order dates written in six ways, and as no date."""
    layouts = ["MM/dd/yyyy", "MM.dd.yyyy HH:mm", "yyyyMMdd", "MMMM d, yyyy", "d MMM yyyy H:mm:ss", "yyyy/MM/dd", "'week' d"]
    day, place = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % len(layouts)
    text = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        text = F.when(place == i, F.date_format(day, layout)).otherwise(text)
    text = F.when((place == 0) & (F.dayofmonth(day) > 12), F.date_format(day, "dd/MM/yyyy")).otherwise(text)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))
    return enrich.enrich(orders, [enrich.DatePart(k, "written", p) for k, p in {"y": "year", "m": "month", "d": "day"}.items()]).select(
        "o_orderkey", "y", "m", "d")


@dataclass(frozen=True)
class ShareOf(enrich.Rule):
    """A rule of the user's own: a field's share of the sum of its group's."""

    value: str
    group: str

    def apply(self, df):
        sums = df.groupBy(self.group).agg(F.sum(self.value).alias("_sum"))
        return lookup_join(df, sums, self.group).withColumn(self.target, F.round(F.col(self.value) / F.col("_sum"), 9)).drop("_sum")


@query("enrich_own_rule", """SELECT s_suppkey, round(p_share, 9) AS p_share, p_share > 0.001 AS large FROM (
SELECT s_suppkey, round(s_acctbal / (sum(s_acctbal) OVER (PARTITION BY s_nationkey)), 9) AS p_share FROM supplier)""")
def enrich_own_rule(spark, sf_dir):
    rules = [ShareOf("p_share", "s_acctbal", "s_nationkey"), enrich.Calculate("large", "p_share > 0.001")]
    return enrich.enrich(table(spark, sf_dir, "supplier"), rules).select("s_suppkey", "p_share", "large")


@query("enrich_category_map", """SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 10 THEN 'small'
WHEN p_size BETWEEN 10 AND 20 THEN 'medium' WHEN p_size BETWEEN 25 AND 40 THEN 'large'
WHEN p_size >= 40 THEN 'large' END AS size_class FROM part""")
def enrich_category_map(spark, sf_dir):
    rule = enrich.CategoryMap("size_class", "p_size", [(0, 10), (10, 20), (25, 40)], ["small", "medium", "large"])
    return rule.apply(table(spark, sf_dir, "part")).select("p_partkey", "size_class")


@query("enrich_conditional", """SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000
THEN 'premium' ELSE 'standard' END AS tier FROM orders""")
def enrich_conditional(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("state", F.expr("nullif(o_orderstatus, 'P')"))
    rule = enrich.Conditional("tier", "state = 'F' and o_totalprice > 100000", "premium", "standard")
    return rule.apply(orders).select("o_orderkey", "tier")


@query("conditional_error", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND (o_totalprice / (o_orderkey % 4) > 90000 OR o_orderstatus = 'P') THEN 'large' ELSE 'usual' END AS size,
       CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 <> 0 AND o_custkey % (o_orderkey % 3) = 1 THEN 'yes' ELSE 'no' END AS odd,
       CASE WHEN coalesce(TRY_CAST(nullif(substr(o_orderpriority, 1, 1), '3') AS INT), 0) >= 4 THEN 1 ELSE 0 END AS late FROM orders""")
def conditional_error(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "level", F.expr("if(o_orderpriority like '3%', 'none', substr(o_orderpriority, 1, 1))"))
    out = enrich.enrich(orders, [
        enrich.Conditional("size", "o_totalprice / (o_orderkey % 4) > 90000 or o_orderstatus = 'P'", "large", "usual"),
        enrich.Conditional("odd", "o_orderstatus = 'F' or o_custkey % (o_orderkey % 3) = 1", "yes", "no"),
        enrich.Conditional("late", "CAST(level AS int) >= 4", 1, 0)])
    return out.select("o_orderkey", "size", "odd", "late")


@query("enrich_derive", """SELECT c_custkey, lower(c_mktsegment) || '/' || c_nationkey AS tag,
CAST(c_acctbal < 0 AS BOOLEAN) AS owes FROM customer""")
def enrich_derive(spark, sf_dir):
    rules = [
        enrich.Derive("tag", lambda c: F.concat(F.lower(c["c_mktsegment"]), F.lit("/"), c["c_nationkey"].cast("string"))),
        enrich.Derive("owes", lambda c: _negative(c["c_acctbal"])),
    ]
    return enrich.enrich(table(spark, sf_dir, "customer"), rules).select("c_custkey", "tag", "owes")


def _negative(c):
    @F.pandas_udf("boolean")
    def below(values: pd.Series) -> pd.Series:
        return values < 0

    return below(c)


@query("scalar_whole_text", """SELECT doc_id, md5(lower(trim(text))) AS whole,
regexp_replace(source, '[0-9]+', '#', 'g') AS family FROM documents""")
def scalar_whole_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.lower(F.trim("text"))).alias("whole"), F.regexp_replace("source", "[0-9]+", "#").alias("family"))


@query("scalar_md5", "SELECT page_id, substr(md5(url), 1, 8) AS url_id, md5(html) AS content FROM pages")
def scalar_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.md5_prefix(F.col("url"), 8).alias("url_id"), F.md5("html").alias("content"))


@query("doc_truncate", "SELECT doc_id, md5(substr(text, 1, 1500)) AS head FROM documents")
def doc_truncate(spark, sf_dir):
    cut = filters.truncate_text(table(spark, sf_dir, "documents"), "text")
    return cut.select("doc_id", F.md5("text").alias("head"))


@query("struct_check", "SELECT 'customer' AS name, count(*) > 0 AS ok FROM customer")
def struct_check(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.limit(1).select(F.lit("customer").alias("name"), F.lit(filters.has_records(customers)).alias("ok"))


def _camel(spark, sf_dir):
    """Customers with camel-case, spaced and nested field names."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customerKey"), F.col("c_name").alias("Full Name"),
        F.struct(F.col("c_nationkey").alias("nationID"), F.col("c_mktsegment").alias("Market-Segment")).alias("accountInfo"),
        F.array(F.struct(F.col("c_acctbal").alias("BalanceUSD"))).alias("balanceList"))


@query("norm_keys", """SELECT c_custkey AS customer_key, c_name AS full_name, c_nationkey AS nation_id,
c_mktsegment AS market_segment, c_acctbal AS balance_usd FROM customer""")
def norm_keys(spark, sf_dir):
    out = names.normalize_names(_camel(spark, sf_dir))
    return out.select("customer_key", "full_name", "account_info.nation_id", "account_info.market_segment",
                      F.col("balance_list")[0]["balance_usd"].alias("balance_usd"))


@query("norm_keys_snake_field", "SELECT c_custkey AS customer_key, c_nationkey AS nation_id FROM customer")
def norm_keys_snake_field(spark, sf_dir):
    out = names.normalize_names(_camel(spark, sf_dir).drop("Full Name", "balanceList"), names.snake_field)
    return out.select("customer_key", "account_info.nation_id")


@query("flatten_nested", """SELECT o_orderkey, l_linenumber AS lines_number, l_quantity AS lines_detail_quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def flatten_nested(spark, sf_dir):
    lines = collect_parts(
        table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        {"number": F.col("l_linenumber"), "detail": F.struct(F.col("l_quantity").alias("quantity"))}, items="lines").drop("part")
    nested = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return reshape.flatten(nested)
