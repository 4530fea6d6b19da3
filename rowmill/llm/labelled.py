"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmill.llm.staging import map_text


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of an id's decimal text modulo a number; a null id gives null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and its label, the largest where an id has several; null labels and ids are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, features: str, function: Callable,
           max_chars: int, use: Column | None = None, extra: tuple[str, ...] = (), values: list | None = None) -> pa.Table:
    """Features of at most ``rows`` labelled documents, as many of each label where there are so many.

    ``docs`` has doc_id, text and the ``extra`` columns, ``labels`` has doc_id and the label (the largest, where an id
    has several; null labels and ids are left out). The sample is the first ids in the order of a hash; documents of
    more than ``max_chars`` characters are not drawn into it, so its size on the driver is bounded by ``rows`` and
    ``max_chars``. Labels that only missing documents have add nothing.
    """
    known = known_labels(labels, label)
    if use is not None:
        known = known.where(use)
    fit = docs.where(F.length(F.coalesce("text", F.lit(""))) <= max_chars).select("doc_id")
    known = known.join(fit, "doc_id", "left_semi")
    if values is None:
        values = grades(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = None
    for value in values:
        some = known.where(F.col("label") == value).orderBy(*order).limit(rows // max(1, len(values)))
        drawn = some if drawn is None else drawn.union(some)
    if drawn is None:
        drawn = known.limit(0)
    drawn = drawn.collect()  # ids and labels of the bounded sample
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "doc_id long, label int")
    texts = docs.select("doc_id", "text", *extra).where(F.length(F.coalesce("text", F.lit(""))) <= max_chars).join(
        F.broadcast(ids), "doc_id")
    texts = texts.dropDuplicates(["doc_id"])
    return map_text(texts, "text", features, function).drop("text").orderBy("doc_id").toArrow()


def grades(labels: DataFrame, label: str, most: int = 100) -> list[int]:
    """The distinct labels in order; more than ``most`` are an error, as grades are few."""
    found = [r[0] for r in labels.select(F.col(label).cast("int").alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{label} has more than {most} values")
    return sorted(found)
