"""Validation queries (V rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import validate as v
from suite.registry import query, table


def _errors(df, rules, key):
    return v.error_rows(df, rules, [key])


@query("validate_required", """
SELECT event_id, 'kind' AS field, 'required_kind' AS rule, 'Field cannot be empty: kind' AS message FROM events
WHERE event_type IN ('error', 'view')
UNION ALL SELECT event_id, 'device', 'required_device', 'Missing required field: device' FROM events""")
def validate_required(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "kind", F.when(F.col("event_type") == "view", "").otherwise(F.expr("nullif(event_type, 'error')")))
    return _errors(events, [v.Required("kind"), v.Required("device")], "event_id")


@query("validate_type", """
SELECT doc_id, 'tail' AS field, 'type_tail' AS rule, 'Field tail must be int, got str' AS message FROM documents
WHERE try_cast(substr(source, 4) || substr(lang, 1, 1) AS BIGINT) IS NULL AND substr(source, 4) <> '7'
UNION ALL SELECT doc_id, 'n_chars', 'type_n_chars', 'Field n_chars must be float, got int' FROM documents""")
def validate_type(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumn(
        "tail", F.when(F.expr("substr(source, 4)") != "7", F.concat(F.expr("substr(source, 4)"), F.expr("substr(lang, 1, 1)"))))
    return _errors(documents, [v.Type("tail", int), v.Type("n_chars", "float"), v.Type("doc_id", int)], "doc_id")


@query("validate_range", """
SELECT c_custkey, 'c_acctbal' AS field, 'range_c_acctbal' AS rule, CASE WHEN c_acctbal < 0 THEN 'c_acctbal below minimum: 0'
ELSE 'c_acctbal above maximum: 9000' END AS message FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000""")
def validate_range(spark, sf_dir):
    rules = [v.Range("c_acctbal", 0, 9000), v.Range("c_name", 0, 1), v.Range("absent", 0, 1)]
    return _errors(table(spark, sf_dir, "customer"), rules, "c_custkey")


@query("validate_pattern", """
SELECT page_id, 'url' AS field, 'pattern_url' AS rule, 'url does not match pattern' AS message FROM pages
WHERE NOT regexp_matches(url, '^(?:https://[a-z.]+/en|http://[a-z.]+/fr)')""")
def validate_pattern(spark, sf_dir):
    return _errors(table(spark, sf_dir, "pages"), [v.Pattern("url", "https://[a-z.]+/en|http://[a-z.]+/fr")], "page_id")


@query("validate_enum", """
SELECT o_orderkey, 'o_orderpriority' AS field, 'enum_o_orderpriority' AS rule,
'o_orderpriority must be one of [''1-URGENT'', ''2-HIGH'']' AS message FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def validate_enum(spark, sf_dir):
    return _errors(table(spark, sf_dir, "orders"), [v.Enum("o_orderpriority", ("1-URGENT", "2-HIGH"))], "o_orderkey")


@query("validate_custom", """
SELECT doc_id, 'text' AS field, 'custom_text' AS rule, 'too short' AS message FROM documents WHERE length(text) < 200""")
def validate_custom(spark, sf_dir):
    return _errors(table(spark, sf_dir, "documents"), [v.Custom("text", lambda c: F.length(c) >= 200, "too short")], "doc_id")


@query("validate_cross_field", """
SELECT o_orderkey, 'o_orderstatus' AS field, 'open_is_cheap' AS rule, 'Cross-field validation failed' AS message FROM orders
WHERE nullif(o_orderstatus, 'P') = 'O' AND o_totalprice >= 250000""")
def validate_cross_field(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    rule = v.CrossField("o_orderstatus", ("o_orderstatus", "o_totalprice"),
                        lambda state, price: (state != "O") | (price < 250000), label="open_is_cheap")
    return _errors(orders, [rule], "o_orderkey")


@query("validate_unique", """
SELECT doc_id, 'text' AS field, 'unique_text' AS rule, 'text is not unique' AS message FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def validate_unique(spark, sf_dir):
    return _errors(table(spark, sf_dir, "documents"), [v.Unique("text")], "doc_id")


@query("validate_removed_rule", """
SELECT o_orderkey, 'o_totalprice' AS field, 'range_o_totalprice' AS rule, 'o_totalprice above maximum: 300000' AS message FROM orders
WHERE o_totalprice > 300000""")
def validate_removed_rule(spark, sf_dir):
    rules = [v.Range("o_totalprice", None, 300000), v.Enum("o_orderstatus", ("O",)), v.Required("o_clerk")]
    for name in ("enum_o_orderstatus", "required_o_clerk", "no_such_rule"):
        rules = v.without_rule(rules, name)
    return _errors(table(spark, sf_dir, "orders"), rules, "o_orderkey")


@query("validate_summary", """
SELECT count(*) = 0 AS valid, CAST(count(*) AS BIGINT) AS error_count, CAST(0 AS BIGINT) AS warning_count FROM (
SELECT 1 FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 1 FROM lineitem WHERE l_quantity < 3)""")
def validate_summary(spark, sf_dir):
    return v.validate(table(spark, sf_dir, "lineitem"), [v.Range("l_discount", 0, 0.05), v.Range("l_quantity", 3)])
