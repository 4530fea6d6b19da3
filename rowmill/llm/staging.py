"""Intermediate tables in the shared folder, names that cannot clash, and Arrow batches cut to a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T

from rowmill.session import staged_path

#: Bytes of text that one call of a batch function gets; a longer single text is handed over alone.
SLICE_BYTES = 1 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs survive lost executors without recomputing it."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each text in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    values = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return values, offsets - first


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay within the limit, where a single text does."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(df: DataFrame, text: str, added: str, function: Callable, setup: Callable | None = None,
             keep_text: bool = True, limit: int = SLICE_BYTES) -> DataFrame:
    """Append columns computed from a text column, in slices of at most ``limit`` bytes of text.

    ``function(values, offsets, state)`` gets the UTF-8 bytes of a slice with the offset of each text and returns
    one Arrow array per added column; ``setup()`` makes ``state`` once per task. Added columns replace columns of
    the same name; the text itself stays unless ``keep_text`` is false.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    work = free_name(df, "_text")
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep_text or f.name.lower() != text.lower())]
    frame = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text}`"].alias(work))
    out = T.StructType(kept + new.fields)

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            for piece in slices(batch, work, limit):
                values, offsets = text_arrays(piece.column(piece.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *function(values, offsets, state)], names=out.names)

    return frame.mapInArrow(run, out)


def lists(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def broadcast_bytes(spark: SparkSession, value):
    """Ship an object of a fixed, known size (a model, a table of classes) to the tasks."""
    return spark.sparkContext.broadcast(value)
