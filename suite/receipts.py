"""Receipt document queries (D, J3, F16-F21 rows): orders are receipts, lineitem their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.operators import documents as d
from rowmill.operators.groups import collect_parts
from rowmill.sources.receipts import insert_receipts
from rowmill.sources.tables import TableStore
from suite.registry import query, table


def _texts(spark, sf_dir):
    """One text per order with its document as JSON: fenced, plain, inside prose, or cut off."""
    lines = collect_parts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"],
                          ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                          {"p": F.col("l_partkey"), "price": F.col("l_extendedprice"), "qty": F.col("l_quantity"), "tax": F.col("l_tax")},
                          items="lines")
    orders = table(spark, sf_dir, "orders").join(lines.hint("merge"), "o_orderkey", "left")  # as it is planned at scale
    items = F.transform("lines", lambda x: F.struct(
        F.concat(F.lit("part "), x["p"].cast("string")).alias("description"), x["qty"].alias("quantity"),
        F.format_string("%.2f", x["price"]).alias("unit_price"), x["price"].alias("line_total")))
    taxes = F.transform(F.filter("lines", lambda x: x["tax"] > 0.05), lambda x: F.struct(
        F.lit("VAT").alias("type"), x["tax"].alias("rate"), x["price"].alias("amount")))
    document = F.to_json(F.struct(
        F.struct(F.concat(F.lit("Shop "), F.col("o_custkey").cast("string")).alias("name"), F.lit("1 Main St").alias("address")).alias("merchant"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("10:30").alias("time"),
                 F.col("o_orderpriority").alias("clerk")).alias("transaction"),
        items.alias("items"),
        F.struct(F.col("o_totalprice").alias("subtotal"), F.col("o_totalprice").alias("total_amount"), taxes.alias("tax_breakdown")).alias("summary"),
        F.struct(F.lit("CASH").alias("method")).alias("payment")))
    kind = F.col("o_orderkey") % 4
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), document, F.lit("\n```")))
        .when(kind == 1, document).when(kind == 2, F.concat(F.lit("Here it is: "), document, F.lit(" Bye.")))
        .otherwise(F.substring(document, 1, 30)))
    number = F.concat_ws("-", "o_orderkey", F.expr("nullif(part, 0)"))  # an order with very many lines gives several texts
    return orders.select("o_orderkey", F.concat(F.lit("r"), number, F.lit(".png")).alias("filename"), wrapped.alias("raw_text"))


def _parsed(spark, sf_dir):
    return d.parse_documents(_texts(spark, sf_dir), "filename", "raw_text")


_GOOD = "o_orderkey % 4 <> 3"


@query("doc_extract_json", """SELECT 'r' || o_orderkey || '.png' AS filename, CASE WHEN o_orderkey % 4 <> 3 THEN 'Shop ' || o_custkey END AS merchant,
o_orderkey % 4 <> 3 AS found FROM orders""")
def doc_extract_json(spark, sf_dir):
    body = text.json_in_text(F.col("raw_text"))
    return _texts(spark, sf_dir).select("filename", F.get_json_object(body, "$.merchant.name").alias("merchant"),
                                        body.isNotNull().alias("found"))


@query("doc_strip_fence", """SELECT doc_id, md5(trim(source || ' ' || lang)) AS body FROM documents""")
def doc_strip_fence(spark, sf_dir):
    plain = F.concat_ws(" ", "source", "lang")
    fenced = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  ```json\n"), plain, F.lit("\n```\n")))
              .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), plain, F.lit("```"))).otherwise(plain))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_fence(fenced)).alias("body"))


@query("doc_repeated_key", """SELECT 'r' || o_orderkey AS receipt_number, CASE WHEN o_orderkey % 5 <> 4 THEN 'Shop ' || o_custkey END AS merchant_name,
CASE WHEN o_orderkey % 5 <> 4 THEN o_totalprice END AS total_amount, o_orderkey % 5 = 4 AS rejected FROM orders""")
def doc_repeated_key(spark, sf_dir):
    """Answers whose JSON repeats keys at two levels, bare, fenced, in prose, or broken off."""
    body = F.format_string('{"merchant": {"name": "old"}, "summary": {"total_amount": 1, "total_amount": %s, "lines": [{"a": 1, "a": 2}]}, "merchant": {"name": "Shop %s"}}',
                           F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"))
    k = F.col("o_orderkey") % 5
    answer = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), body, F.lit(" done.")))
              .when(k == 3, F.concat(F.lit(" \n"), body, F.lit("\n"))).otherwise(F.concat(body, F.lit(", "), body)))
    parsed = d.parse_documents(table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), answer.alias("answer")),
                               "name", "answer")
    whole = parsed.select("receipt_number", F.col("json").isNull().alias("rejected"))
    heads = d.shred_headers(parsed).select("receipt_number", "merchant_name", F.col("total_amount").cast("double").alias("total_amount"))
    return whole.join(heads, "receipt_number", "left").select("receipt_number", "merchant_name", "total_amount", "rejected")


@query("doc_rejects", "SELECT 'r' || o_orderkey || '.png' AS receipt_number FROM orders WHERE o_orderkey % 4 = 3")
def doc_rejects(spark, sf_dir):
    return d.rejects(_parsed(spark, sf_dir)).select("receipt_number")


@query("doc_shred_header", f"""SELECT 'r' || o_orderkey || '.png' AS receipt_number, 'Shop ' || o_custkey AS merchant_name,
strftime(o_orderdate, '%Y-%m-%d') AS transaction_date, o_orderpriority AS clerk, o_totalprice AS total_amount,
CAST(NULL AS DOUBLE) AS tax_amount, 'CASH' AS payment_method FROM orders WHERE {_GOOD}""")
def doc_shred_header(spark, sf_dir):
    return d.shred_headers(_parsed(spark, sf_dir)).select(
        "receipt_number", "merchant_name", F.col("transaction_date").cast("string").alias("transaction_date"), "clerk",
        F.col("total_amount").cast("double").alias("total_amount"), F.col("tax_amount").cast("double").alias("tax_amount"),
        "payment_method")


_ITEMS = f"""SELECT 'r' || l_orderkey || '.png' AS receipt_number, 'part ' || l_partkey AS description, l_quantity AS quantity,
l_extendedprice AS unit_price, l_extendedprice AS line_total, l_tax, l_linenumber, l_partkey, l_suppkey, l_orderkey
FROM lineitem WHERE l_orderkey % 4 <> 3 AND l_orderkey IN (SELECT o_orderkey FROM orders)"""


@query("doc_shred_items", f"SELECT receipt_number, description, quantity, unit_price, line_total FROM ({_ITEMS})")
def doc_shred_items(spark, sf_dir):
    out = d.shred_items(_parsed(spark, sf_dir)).drop("line")
    return out.select("receipt_number", "description", *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "line_total")])


@query("doc_shred_taxes", f"SELECT receipt_number, 'VAT' AS tax_type, l_tax AS tax_rate, line_total AS tax_amount FROM ({_ITEMS}) WHERE l_tax > 0.05")
def doc_shred_taxes(spark, sf_dir):
    out = d.shred_taxes(_parsed(spark, sf_dir))
    return out.select("receipt_number", "tax_type", F.col("tax_rate").cast("double").alias("tax_rate"),
                      F.col("tax_amount").cast("double").alias("tax_amount"))


def _tables(spark, sf_dir):
    """The three receipt tables straight from orders and lineitem."""
    number = lambda key: F.concat(F.lit("r"), F.col(key).cast("string"))
    money = lambda c: F.col(c).cast(d.MONEY)
    none = lambda kind: F.lit(None).cast(kind)
    headers = table(spark, sf_dir, "orders").select(
        number("o_orderkey").alias("receipt_number"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Shop "), F.col("o_custkey").cast("string"))).alias("merchant_name"),
        none("string").alias("merchant_address"), F.lit("555").alias("merchant_phone"), none("string").alias("merchant_tax_id"),
        F.to_date("o_orderdate").alias("transaction_date"), none("string").alias("transaction_time"),
        F.col("o_orderpriority").alias("clerk"), money("o_totalprice").alias("subtotal"), none(d.MONEY).alias("tax_amount"),
        money("o_totalprice").alias("total_amount"), F.lit("CASH").alias("payment_method"),
        money("o_totalprice").alias("amount_tendered"), F.lit(0).cast(d.MONEY).alias("change_due"))
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "line", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).withColumn("receipt_number", number("l_orderkey"))
    items = lines.select("receipt_number", "line", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
                         F.col("l_quantity").cast(d.QUANTITY).alias("quantity"), money("l_extendedprice").alias("unit_price"),
                         money("l_extendedprice").alias("line_total"))
    taxes = lines.where("l_tax > 0.05").select("receipt_number", "line", F.lit("VAT").alias("tax_type"),
                                               F.col("l_tax").cast(d.RATE).alias("tax_rate"), money("l_extendedprice").alias("tax_amount"))
    return headers, items, taxes


_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("join_nest_children", f"""
WITH i AS (SELECT l_orderkey, count(*) AS n, string_agg('part ' || l_partkey || '/' || CAST(l_extendedprice AS DECIMAL(12, 2)), ';' {_ORDER}) AS items
  FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, string_agg(CAST(l_tax AS DECIMAL(6, 4)), ';' {_ORDER}) AS taxes FROM lineitem WHERE l_tax > 0.05 GROUP BY ALL)
SELECT 'r' || o_orderkey AS receipt_number, CAST(0 AS BIGINT) AS part, CASE WHEN o_orderstatus <> 'P' THEN 'Shop ' || o_custkey END AS merchant,
  CAST(coalesce(n, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, coalesce(taxes, '') AS taxes
FROM orders LEFT JOIN i ON o_orderkey = i.l_orderkey LEFT JOIN t ON o_orderkey = t.l_orderkey""")
def join_nest_children(spark, sf_dir):
    out = d.assemble(*_tables(spark, sf_dir))
    item = lambda x: F.concat(x["description"], F.lit("/"), x["line_total"].cast("string"))
    return out.select("receipt_number", "part", F.col("merchant.name").alias("merchant"), F.size("items").cast("long").alias("n_items"),
                      F.array_join(F.transform("items", item), ";").alias("items"),
                      F.array_join(F.transform("tax_breakdown", lambda x: x["rate"].cast("string")), ";").alias("taxes"))


_INPUT = f"""
WITH i AS (SELECT l_orderkey, string_agg('  - part ' || l_partkey || ': qty=' || CAST(l_quantity AS DECIMAL(10, 2)) || ', price=' ||
  CAST(l_extendedprice AS DECIMAL(12, 2)) || ', total=' || CAST(l_extendedprice AS DECIMAL(12, 2)), chr(10) {_ORDER}) AS items FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, string_agg('  - VAT: rate=' || CAST(l_tax AS DECIMAL(6, 4)) || ', amount=' || CAST(l_extendedprice AS DECIMAL(12, 2)),
  chr(10) {_ORDER}) AS taxes FROM lineitem WHERE l_tax > 0.05 GROUP BY ALL),
x AS (SELECT o_orderkey, o_custkey, 'Extract receipt data and return as JSON.' || chr(10) || chr(10) || 'Merchant: Shop ' || o_custkey || chr(10) ||
  'Address: N/A' || chr(10) || 'Phone: 555' || chr(10) || 'Tax ID: N/A' || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) ||
  'Time: N/A' || chr(10) || 'Clerk: ' || o_orderpriority || chr(10) || 'Payment: CASH ' || CAST(o_totalprice AS DECIMAL(12, 2)) ||
  ' / Change: N/A' || chr(10) || 'Subtotal: ' || CAST(o_totalprice AS DECIMAL(12, 2)) || chr(10) || 'Tax: None' || chr(10) || 'Total: ' ||
  CAST(o_totalprice AS DECIMAL(12, 2)) || chr(10) || coalesce(chr(10) || '- Items:' || chr(10) || items, '') || chr(10) ||
  coalesce(chr(10) || '- Tax breakdown:' || chr(10) || taxes, '') AS input
  FROM orders LEFT JOIN i ON o_orderkey = i.l_orderkey LEFT JOIN t ON o_orderkey = t.l_orderkey WHERE o_orderstatus <> 'P')"""


@query("doc_instruction_set", _INPUT + f""" SELECT 'r' || o_orderkey AS receipt_number, '{d.INSTRUCTION}' AS instruction, input,
'Shop ' || o_custkey AS output_merchant FROM x""")
def doc_instruction_set(spark, sf_dir):
    rows = d.instruction_rows(d.assemble(*_tables(spark, sf_dir)))
    return rows.select("receipt_number", "instruction", "input", F.get_json_object("output", "$.merchant.name").alias("output_merchant"))


@query("doc_chat_template", """SELECT conv_id, turn, '<|im_start|>user' || chr(10) || role || chr(10) || text || '<|im_end|>' || chr(10) ||
'<|im_start|>assistant' || chr(10) || upper(role) || '<|im_end|>' || chr(10) AS text FROM conversations""")
def doc_chat_template(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", d.chat_text(F.col("role"), F.col("text"), F.upper("role")).alias("text"))


@query("doc_star_checks", """SELECT receipt_number, CASE WHEN receipt_number = '' THEN 'Field cannot be empty: receipt_number' ELSE '' END ||
CASE WHEN n > 1 THEN '|receipt_number is not unique' ELSE '' END AS messages FROM (
SELECT CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS receipt_number,
  count(*) OVER (PARTITION BY CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END) AS n FROM orders)""")
def doc_star_checks(spark, sf_dir):
    keyed = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("receipt_number"))
    checked = d.star_checks(keyed)
    empty = F.coalesce(F.get(F.filter("errors", lambda e: e["rule"] == "required_receipt_number"), F.lit(0))["message"], F.lit(""))
    double = F.coalesce(F.concat(F.lit("|"), F.get(F.filter("errors", lambda e: e["rule"] == "unique_receipt_number"), F.lit(0))["message"]), F.lit(""))
    return checked.select("receipt_number", F.concat(empty, double).alias("messages"))


@query("doc_sample_block", """WITH k AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents QUALIFY i < 10)
SELECT string_agg(chr(10) || '--- RECEIPT ' || i || ' (' || source || ') ---' || chr(10) || substr(text, 1, 1500) || chr(10), '' ORDER BY i) AS block
FROM k WHERE i > 0""")
def doc_sample_block(spark, sf_dir):
    return d.sample_block(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query("doc_first_ten", """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
WHERE k = 1 ORDER BY doc_id LIMIT 10""")
def doc_first_ten(spark, sf_dir):
    return d.first_documents(table(spark, sf_dir, "documents"), "source", "doc_id").select("doc_id", "source")


@query("doc_schema_merge", """SELECT 'OBJECT<event_id: BIGINT, k: BIGINT, kind: STRING>' AS schema FROM events HAVING count(*) > 0""")
def doc_schema_merge(spark, sf_dir):
    line = F.when(F.col("event_type") == "error", "{broken").when(
        F.col("event_type") == "click", F.col("props")).otherwise(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))))
    return d.merged_schema(table(spark, sf_dir, "events"), line)


@query("doc_result_rows", """SELECT 'r' || o_orderkey || '.png' AS source_file, 'png' AS image_type, 1.0::DOUBLE AS confidence,
CASE WHEN o_orderkey % 4 <> 3 THEN 'Shop ' || o_custkey END AS merchant, o_orderkey % 4 = 3 AS has_text FROM orders""")
def doc_result_rows(spark, sf_dir):
    texts = _texts(spark, sf_dir).select(F.concat(F.lit("/scans/"), "filename").alias("path"), F.lit("png").alias("kind"), "raw_text")
    rows = d.result_rows(texts, "path", "kind", "raw_text")
    return rows.select("source_file", "image_type", "confidence", F.get_json_object("fields", "$.merchant.name").alias("merchant"),
                       F.get_json_object("fields", "$.text").isNotNull().alias("has_text"))


@query("receipts_insert", f"""
SELECT 'receipts' AS name, count(*) AS n FROM orders WHERE {_GOOD}
UNION ALL SELECT 'receipt_items', count(*) FROM ({_ITEMS})
UNION ALL SELECT 'receipt_tax_breakdown', count(*) FROM ({_ITEMS}) WHERE l_tax > 0.05
UNION ALL SELECT 'second_run', count(*) FROM orders WHERE {_GOOD} AND o_orderstatus = 'F'""")
def receipts_insert(spark, sf_dir):
    """Two loads that overlap: the second adds only what the first did not store."""
    store, prefix = TableStore(spark), f"t_{uuid.uuid4().hex}_"
    texts = _texts(spark, sf_dir)
    first = texts.join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey", "left_semi")
    insert_receipts(store, d.parse_documents(first, "filename", "raw_text"), prefix)
    added = insert_receipts(store, d.parse_documents(texts, "filename", "raw_text"), prefix).count()
    counts = [store.load(prefix + n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
              for n in ("receipts", "receipt_items", "receipt_tax_breakdown")]
    second = spark.createDataFrame([("second_run", added)], "name string, n long")
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(second)


@query("receipts_first_wins", f"""SELECT 'Shop ' || min(o_custkey) AS merchant_name, 'c' || (o_orderkey // 8) AS receipt_number
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) AS nth FROM orders WHERE {_GOOD}) WHERE nth = 1 GROUP BY o_orderkey // 8""")
def receipts_first_wins(spark, sf_dir):
    """Several receipts of one number: the one that arrived first is stored; a batch sent twice is loaded once."""
    store, prefix = TableStore(spark), f"t_{uuid.uuid4().hex}_"
    texts = _texts(spark, sf_dir).withColumn("number", F.concat(F.lit("c"), F.floor(F.col("o_orderkey") / 8).cast("string")))
    parsed = d.parse_documents(texts, "number", "raw_text", keep=("o_orderkey",))
    for _ in range(2):
        insert_receipts(store, parsed, prefix, batch_id="first", order_by="o_orderkey")
    return store.load(prefix + "receipts").select("merchant_name", "receipt_number")
