"""The receipts store: three tables that grow together, and a log of the loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from rowmill.operators.documents import shred_headers, shred_items, shred_taxes
from rowmill.operators.joins import first_per_key, is_in, not_in
from rowmill.session import shared_dir
from rowmill.sources.tables import TableStore

TABLES = ("receipts", "receipt_items", "receipt_tax_breakdown")
LOADS = "receipt_loads"


def _log(store: TableStore, name: str, batch_id: str, attempt: str, state: str) -> None:
    entry = store.spark.createDataFrame([(batch_id, attempt, state)], "batch_id string, attempt string, state string")
    store.store(name, entry.withColumn("logged_at", F.current_timestamp()))


def _unfinished(store: TableStore, name: str) -> list[tuple[str, str]]:
    """batch_id and attempt of the loads that began and have no end: few, as each load closes those before it."""
    if not store.exists(name):
        return []
    open_loads = store.load(name).groupBy("batch_id", "attempt").agg(F.bool_and(F.col("state") == "started").alias("open"))
    return [(r["batch_id"], r["attempt"]) for r in open_loads.where("open").collect()]


def stored_numbers(store: TableStore, table: str, fresh: DataFrame) -> DataFrame:
    """The receipt numbers of ``fresh`` that ``table`` holds: the scan reads one column, between the ends of the new numbers.

    The stored side is filtered by the new numbers, broadcast where they are few, so the store is not shuffled for a small load.
    """
    ends = fresh.agg(F.min("receipt_number").alias("low"), F.max("receipt_number").alias("high")).first()
    near = store.load(table).where(F.col("receipt_number").between(ends["low"], ends["high"]))
    return is_in(near.select("receipt_number"), fresh, "receipt_number")


def insert_receipts(store: TableStore, parsed: DataFrame, prefix: str = "", batch_id: str | None = None,
                    order_by: str = "json") -> DataFrame:
    """Add the receipts whose number is not stored yet, with their items and taxes; returns the new headers.

    Of new receipts with one number the first by ``order_by`` stays: name the column that holds the order of arrival, and
    of equal ones the JSON text that sorts first. A ``batch_id`` that was loaded before adds nothing. Headers go last: a receipt
    counts as stored only when its items and taxes are written. The log tells whether a load ended between; only then
    are items and taxes without a header looked for and removed. Loads of one store follow each other.
    """
    names = [prefix + t for t in TABLES]
    log = prefix + LOADS
    shared_dir(store.spark)
    if batch_id is not None and store.exists(log) and not store.load(log, {"batch_id": batch_id, "state": "done"}).isEmpty():
        return shred_headers(parsed.limit(0))
    unfinished = _unfinished(store, log)
    if unfinished:
        for name in names[1:]:
            if not store.exists(name):
                continue
            if store.exists(names[0]):
                store.overwrite(name, is_in(store.load(name), store.load(names[0]), "receipt_number"))
            else:
                store.drop(name)
        for left in unfinished:
            _log(store, log, *left, "removed")
    order = [order_by] if order_by == "json" else [order_by, "json"]
    needed = parsed.where("json is not null").drop(*[c for c in ("raw_text", "doc") if c != order_by.split(".")[0]])  # the JSON holds all
    fresh = first_per_key(needed, "receipt_number", order).checkpoint()
    if store.exists(names[0]) and not fresh.isEmpty():
        fresh = not_in(fresh, stored_numbers(store, names[0], fresh), "receipt_number").checkpoint()
    attempt = uuid.uuid4().hex
    batch = batch_id if batch_id is not None else attempt
    _log(store, log, batch, attempt, "started")
    store.store(names[1], shred_items(fresh))
    store.store(names[2], shred_taxes(fresh))
    headers = shred_headers(fresh)
    store.store(names[0], headers)
    _log(store, log, batch, attempt, "done")
    return headers
