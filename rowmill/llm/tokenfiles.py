"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowmill.llm.pretokens import bounds, codepoint_classes, distinct, spread
from rowmill.llm.staging import broadcast_bytes, lists, slices, text_arrays
from rowmill.session import shuffle_partitions

#: Pre-tokens whose ids a worker remembers; the memory is emptied when it is full.
CACHE = 300_000
STRIPE_BYTES, INDEX_ROWS = 64 << 20, 1000
_ID = attrgetter("id")


def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


@functools.cache
def _class_bytes(content: str) -> bytes:
    """Classes of all code points; characters newer than Python's tables are asked from the library."""
    split = _tokenizer(content).pre_tokenizer.pre_tokenize_str

    def probe(characters):
        kinds = np.zeros(len(characters), np.uint8)
        for kind, lead in ((1, "a"), (2, "1")):
            for low in range(0, len(characters), 5000):
                some = characters[low:low + 5000]
                for _, (start, end) in split("".join(f" {lead}{c}" for c in some)):
                    if end - start == 3:
                        kinds[low + start // 3] = kind
        return kinds

    return zlib.compress(codepoint_classes(probe).tobytes())


def _by_pieces(content: str) -> bool:
    """Whether the library's ids of a text are those of its pre-tokens: byte-level pieces by the usual pattern, merged as they are."""
    told = json.loads(content)
    split, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    return (not told.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True)
            and split.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout")
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))


def _byte_letters() -> np.ndarray:
    """The letter by which byte-level vocabularies write each byte: visible Latin-1 characters stand for themselves."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = np.arange(0x100, dtype="<u4")
    hidden = [b for b in range(0x100) if b not in visible]
    letters[hidden] = 0x100 + np.arange(len(hidden))
    return letters


class LibraryIds(dict):
    """Ids of pre-tokens, as little-endian 32-bit integers, by the tokenizers library: its model is asked once for each
    distinct pre-token of a slice, written in the letters of its vocabulary."""

    def __init__(self, tokenizer, limit: int = CACHE):
        super().__init__()
        self.tokenizer, self.model, self.letters, self.limit = tokenizer, tokenizer.model, _byte_letters(), limit
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these different pre-tokens; the model is asked for those that were not met yet."""
        out = list(map(self.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        if len(self) + len(new) > self.limit:
            self.clear()
        asked = [pieces[k] for k in new]
        written = self.letters.take(np.frombuffer(b"".join(asked), np.uint8)).tobytes().decode("utf-32-le")
        ask, start = self.model.tokenize, 0
        for k, piece in zip(new, asked):
            end = start + len(piece)
            out[k] = self[piece] = array("i", map(_ID, ask(written[start:end]))).tobytes()
            start = end
        return out

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<i4")


@functools.lru_cache(maxsize=1)
def _worker_ids(content: str) -> LibraryIds:
    """The library and the ids it gave, kept for the next tasks of the same Python worker."""
    return LibraryIds(_tokenizer(content))


def encode_slice(values, offsets, classes, found: LibraryIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts, one after the other, and the number of ids of each (without classes: the library's of
    whole texts). Texts in which an added token of the
    tokenizer's file is written out (``<|endoftext|>``) go to the library whole, which gives that token's own id."""
    data = values.tobytes()
    if classes is None:
        parts = [found.whole(data[a:b]) for a, b in pairwise(offsets.tolist())]
        return np.concatenate([np.zeros(0, "<i4"), *parts]), np.array([len(p) for p in parts], np.int64)
    cut, first = bounds(values, offsets, classes)
    once, number = distinct(values, cut)
    pieces = [data[a:b] for a, b in zip(cut[once].tolist(), cut[once + 1].tolist())]
    groups = found.of(pieces)
    own = np.fromiter(map(len, groups), np.int64, len(groups)) // 4
    ids, sizes = spread(np.frombuffer(b"".join(groups), "<i4"), own, number)
    counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])
    if any(t in data for t in found.added):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, (a, b) in enumerate(pairwise(offsets.tolist())):
            if any(t in data[a:b] for t in found.added):
                parts[k] = found.whole(data[a:b])
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    return ids, counts


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write the ids of every text, with ``end_id`` after each, as ORC files in ascending order of the ids of documents.

    Texts are range-partitioned and sorted by id (equal ids by a hash of the text, null ids first) and encoded while
    their file is written. Columns: doc_id, before (ids of the task's earlier documents), n_tokens, ids. Integers are
    run-length coded by ORC; each file has an index entry per 1000 rows and Bloom filters on doc_id, so that readers
    skip files, stripes and row groups by their metadata, and stripes are read in parallel.
    A null text is empty: its only id is ``end_id``. Rows that repeat an id or a text are documents of their own. The tokenizer's file is
    read on the driver and broadcast. Pre-tokens are looked up one by one only for plain byte-level merges; of a file
    with a normalizer, another splitter, a space put in front, or dropout, the library gets the texts whole.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    shared = broadcast_bytes(df.sparkSession, (content, _class_bytes(content) if _by_pieces(content) else None))
    schema = T._parse_datatype_string("doc_id long, before long, n_tokens long, ids array<int>")

    def run(batches):
        content, packed = shared.value
        classes = None if packed is None else np.frombuffer(zlib.decompress(packed), np.uint8)
        found, before = _worker_ids(content), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                values, offsets = text_arrays(piece.column(1))
                ids, counts = encode_slice(values, offsets, classes, found)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = before + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ends - counts), pa.array(counts), lists(ids, counts, pa.int32())],
                                                 names=schema.names)
                before = int(ends[-1])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    laid = docs.repartitionByRange(shuffle_partitions(df.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    laid.mapInArrow(run, schema).write.option("compression", "none").option("orc.stripe.size", STRIPE_BYTES).option(
        "orc.row.index.stride", INDEX_ROWS).option("orc.bloom.filter.columns", "doc_id").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; with ``doc_ids`` only these documents' stripes.

    Tasks are in the order of their numbers, which their files' names hold; a task may have written several files. The ids before each
    task are the sums of the earlier ones, one number per task, which the driver adds up.
    """
    schema = "doc_id long, before long, n_tokens long, ids array<int>"
    task = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    files = spark.read.schema(schema).orc(path).withColumn("task", task)
    sizes = files.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect()
    starts, seen = [], 0
    for row in sorted(sizes):
        starts.append((row["task"], seen))
        seen += row["n"]
    if doc_ids is not None:
        files = files.where(F.col("doc_id").isin(doc_ids))
    known = F.broadcast(spark.createDataFrame(starts, "task long, task_start long"))  # one row per task that wrote
    return files.join(known, "task").select("doc_id", (F.col("task_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksum(df: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace the ids by the unsigned CRC-32 of their little-endian 32-bit form."""
    kept = [f for f in df.schema.fields if f.name not in (ids, out)]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return df.select(*[f.name for f in kept], ids).mapInArrow(run, schema)
