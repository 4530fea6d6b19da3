"""Receipt documents: JSON in text, shredding into three tables and assembling them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmill.functions.text import json_in_answer
from rowmill.operators.groups import GROUP_ROWS, collect_parts
from rowmill.operators.joins import first_per_key
from rowmill.operators.sampling import head
from rowmill.operators.validate import Required, Unique, with_errors

# The document's layout. Leaves are read as text and cast per table, so a number in quotes works.
_MERCHANT = "merchant STRUCT<name: STRING, address: STRING, phone: STRING, tax_id: STRING>"
_PAYMENT = "payment STRUCT<method: STRING, amount_tendered: STRING, change_due: STRING>"
ITEMS = "items ARRAY<STRUCT<description: STRING, quantity: STRING, unit_price: STRING, line_total: STRING>>"
_TAXES = "tax_breakdown: ARRAY<STRUCT<type: STRING, rate: STRING, amount: STRING>>"
DOCUMENT = (
    f"{_MERCHANT}, transaction STRUCT<date: STRING, time: STRING, receipt_number: STRING, clerk: STRING>, {ITEMS}, "
    f"summary STRUCT<subtotal: STRING, tax_amount: STRING, total_amount: STRING, {_TAXES}>, {_PAYMENT}"
)
# The part of the layout that a table needs: the parser skips all else.
HEADER = (f"{_MERCHANT}, transaction STRUCT<date: STRING, time: STRING, clerk: STRING>, "
          f"summary STRUCT<subtotal: STRING, tax_amount: STRING, total_amount: STRING>, {_PAYMENT}")
TAXES = f"summary STRUCT<{_TAXES}>"
MONEY, QUANTITY, RATE = "decimal(12,2)", "decimal(10,2)", "decimal(6,4)"

INSTRUCTION = "Extract structured data from this receipt and return as JSON."  # fixed value


def first_documents(df: DataFrame, name: str, order_by, size: int = 10) -> DataFrame:
    """The first record of every file name, and of those the first ten."""
    return head(first_per_key(df, name, order_by), order_by, size)


def sample_block(df: DataFrame, name: str, text: str, order_by, length: int = 1500) -> DataFrame:
    """One row with the numbered texts of the documents after the first of at most ten."""
    ten = head(df.select(F.col(order_by).alias("_o"), F.col(name).alias("_n"), F.col(text).alias("_t")), "_o")
    ordered = ten.agg(F.array_sort(F.collect_list(F.struct("_o", "_n", "_t"))).alias("d"))
    part = lambda x, i: F.concat(F.lit("\n--- RECEIPT "), i.cast("string"), F.lit(" ("), x["_n"].cast("string"),
                                 F.lit(") ---\n"), F.substring(x["_t"], 1, length), F.lit("\n"))
    listed = F.filter(F.transform("d", lambda x, i: F.when(i > 0, part(x, i))), lambda x: x.isNotNull())
    return ordered.select(F.array_join(listed, "").alias("block"))


def merged_schema(df: DataFrame, json: Column) -> DataFrame:
    """One row with the schema that covers all documents; text that is no JSON is left out."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("schema"))


def parse_documents(df: DataFrame, name: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``receipt_number`` (the file name), the parsed document and its JSON text, null where there is none.

    Columns of ``keep`` come along, e.g. the order in which documents arrived.
    """
    # The generator row computes the JSON once; a plain projection would be copied into every later filter.
    found = F.explode(F.array(json_in_answer(F.col(text))))
    return df.select(F.col(name).cast("string").alias("receipt_number"), F.col(text).alias("raw_text"),
                     found.alias("json"), *keep).withColumn("doc", F.from_json("json", DOCUMENT))


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("json").isNull()).select("receipt_number", "raw_text")


def shred_headers(parsed: DataFrame) -> DataFrame:
    """The receipts table."""
    money = lambda path: F.col(path).try_cast(MONEY)
    return parsed.where(F.col("json").isNotNull()).withColumn("doc", F.from_json("json", HEADER)).select(
        "receipt_number",
        F.col("doc.merchant.name").alias("merchant_name"), F.col("doc.merchant.address").alias("merchant_address"),
        F.col("doc.merchant.phone").alias("merchant_phone"), F.col("doc.merchant.tax_id").alias("merchant_tax_id"),
        F.col("doc.transaction.date").try_cast("date").alias("transaction_date"),
        F.col("doc.transaction.time").alias("transaction_time"), F.col("doc.transaction.clerk").alias("clerk"),
        money("doc.summary.subtotal").alias("subtotal"), money("doc.summary.tax_amount").alias("tax_amount"),
        money("doc.summary.total_amount").alias("total_amount"), F.col("doc.payment.method").alias("payment_method"),
        money("doc.payment.amount_tendered").alias("amount_tendered"),
        money("doc.payment.change_due").alias("change_due"))


def shred_items(parsed: DataFrame) -> DataFrame:
    """The receipt_items table; ``line`` is the position in the document."""
    rows = parsed.select("receipt_number", F.posexplode(F.from_json("json", ITEMS)["items"]).alias("line", "i"))
    return rows.select(
        "receipt_number", "line", F.col("i.description").alias("description"),
        F.col("i.quantity").try_cast(QUANTITY).alias("quantity"),
        F.col("i.unit_price").try_cast(MONEY).alias("unit_price"), F.col("i.line_total").try_cast(MONEY).alias("line_total"))


def shred_taxes(parsed: DataFrame) -> DataFrame:
    """The receipt_tax_breakdown table."""
    rows = parsed.select("receipt_number", F.posexplode(F.from_json("json", TAXES)["summary"]["tax_breakdown"]).alias("line", "t"))
    return rows.select(
        "receipt_number", "line", F.col("t.type").alias("tax_type"),
        F.col("t.rate").try_cast(RATE).alias("tax_rate"), F.col("t.amount").try_cast(MONEY).alias("tax_amount"))


def star_checks(headers: DataFrame) -> DataFrame:
    """The receipts with their errors: the number is required and unique."""
    return with_errors(headers, [Required("receipt_number"), Unique("receipt_number")])


def assemble(headers: DataFrame, items: DataFrame, taxes: DataFrame, max_items: int = GROUP_ROWS) -> DataFrame:
    """One nested document per receipt; ``items`` and ``taxes`` carry ``line`` for their order.

    Each child is gathered on its own before the join. A receipt with more children than ``max_items``
    continues in further rows with the same header, numbered by ``part``.
    """
    key = ["receipt_number"]
    lines = collect_parts(items, key, "line", {c: F.col(c) for c in (
        "description", "quantity", "unit_price", "line_total")}, max_items, items="items", part="part")
    rates = collect_parts(taxes, key, "line", {
        "type": F.col("tax_type"), "rate": F.col("tax_rate"), "amount": F.col("tax_amount")},
        max_items, items="tax_breakdown", part="part")
    children = lines.join(rates, [*key, "part"], "full")
    nested = headers.select(
        "receipt_number",
        F.struct(F.col("merchant_name").alias("name"), F.col("merchant_address").alias("address"),
                 F.col("merchant_phone").alias("phone"), F.col("merchant_tax_id").alias("tax_id")).alias("merchant"),
        F.struct(F.col("transaction_date").alias("date"), F.col("transaction_time").alias("time"),
                 "clerk").alias("transaction"),
        F.struct("subtotal", "tax_amount", "total_amount").alias("summary"),
        F.struct(F.col("payment_method").alias("method"), "amount_tendered", "change_due").alias("payment"))
    joined = nested.join(children, key, "left")
    return joined.withColumns({
        "part": F.coalesce("part", F.lit(0).cast("long")),
        "items": F.coalesce("items", F.array().cast(joined.schema["items"].dataType)),
        "tax_breakdown": F.coalesce("tax_breakdown", F.array().cast(joined.schema["tax_breakdown"].dataType)),
    })


def _shown(c: Column, missing: str = "N/A") -> Column:
    text = c.cast("string")
    return F.when(text.isNull() | (text == "") | (text.try_cast("double") == 0), F.lit(missing)).otherwise(text)


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _bullets(title: str, rows: Column, named: str, line) -> Column:
    kept = F.filter(rows, lambda x: x[named].isNotNull() & (x[named] != ""))
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"\n- {title}:\n"), F.array_join(F.transform(kept, line), "\n"))
                  ).otherwise("")


def instruction_rows(documents: DataFrame) -> DataFrame:
    """instruction, input and output text of every document that has a merchant name."""
    m, t, s, p = "merchant", "transaction", "summary", "payment"
    item = lambda x: F.concat(F.lit("  - "), x["description"], F.lit(": qty="), _number(x["quantity"]),
                              F.lit(", price="), _number(x["unit_price"]), F.lit(", total="), _number(x["line_total"]))
    tax = lambda x: F.concat(F.lit("  - "), x["type"], F.lit(": rate="), _number(x["rate"]),
                             F.lit(", amount="), _number(x["amount"]))
    lines = [
        F.lit("Extract receipt data and return as JSON."), F.lit(""),
        F.concat(F.lit("Merchant: "), _shown(F.col(f"{m}.name"))),
        F.concat(F.lit("Address: "), _shown(F.col(f"{m}.address"))),
        F.concat(F.lit("Phone: "), _shown(F.col(f"{m}.phone"))),
        F.concat(F.lit("Tax ID: "), _shown(F.col(f"{m}.tax_id"))),
        F.concat(F.lit("Date: "), _shown(F.col(f"{t}.date"))),
        F.concat(F.lit("Time: "), _shown(F.col(f"{t}.time"))),
        F.concat(F.lit("Clerk: "), _shown(F.col(f"{t}.clerk"))),
        F.concat(F.lit("Payment: "), _shown(F.col(f"{p}.method")), F.lit(" "), _shown(F.col(f"{p}.amount_tendered"), ""),
                 F.lit(" / Change: "), _shown(F.col(f"{p}.change_due"))),
        F.concat(F.lit("Subtotal: "), _number(F.col(f"{s}.subtotal"))),
        F.concat(F.lit("Tax: "), _number(F.col(f"{s}.tax_amount"))),
        F.concat(F.lit("Total: "), _number(F.col(f"{s}.total_amount"))),
        _bullets("Items", F.col("items"), "description", item),
        _bullets("Tax breakdown", F.col("tax_breakdown"), "type", tax),
    ]
    output = F.to_json(F.struct(m, t, "items", s, p), {"pretty": "true", "ignoreNullFields": "false"})
    named = documents.where(F.coalesce(F.col("merchant.name"), F.lit("")) != "")
    return named.select("receipt_number", "part", F.lit(INSTRUCTION).alias("instruction"),
                        F.array_join(F.array(*lines), "\n").alias("input"), output.alias("output"))


def chat_text(instruction: Column, input_text: Column, output: Column) -> Column:
    """The two turns in chat markup."""
    return F.concat(F.lit("<|im_start|>user\n"), instruction, F.lit("\n"), input_text, F.lit("<|im_end|>\n"),
                    F.lit("<|im_start|>assistant\n"), output, F.lit("<|im_end|>\n"))


def result_rows(df: DataFrame, path: str, image_type: str, text: str) -> DataFrame:
    """source_file, image_type, extracted_text, fields and confidence for texts that are already extracted.

    Fields are the JSON found in the text, or the text itself with confidence 1.0.
    """
    found = json_in_answer(F.col(text))
    return df.select(
        F.regexp_extract(path, r"([^/\\]*)$", 1).alias("source_file"), F.col(image_type).alias("image_type"),
        F.col(text).alias("extracted_text"),
        F.coalesce(found, F.to_json(F.struct(F.col(text).alias("text")))).alias("fields"),
        F.lit(1.0).alias("confidence"))
