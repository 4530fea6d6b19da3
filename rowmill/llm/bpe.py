"""Byte-level BPE by a file of ranks: scanned pre-tokens, cached pair merging side by side, token offsets, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rowmill.llm.pretokens import bounds, codepoint_classes, distinct, spread
from rowmill.llm.staging import broadcast_bytes, free_name, lists, map_text

#: Bytes of merged pre-tokens that a worker remembers (with what Python adds to each); the memory is emptied when it is full.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 180
#: Bytes of text that are scanned at a time.
SLICE = 1 << 19
#: Tokens whose bytes are put together at a time.
TOKENS = 1 << 15
#: Longer pre-tokens are merged with a heap.
SHORT = 96


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _class_bytes() -> bytes:
    """Classes of all code points, compressed: characters newer than Python's tables are asked from tiktoken."""
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {bytes([b]): b for b in range(256)}
    for lead in (b"a", b"1"):
        for b in range(256):
            ranks[lead + bytes([b])] = len(ranks)
    encode = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def probe(characters):
        return np.array([1 if encode("a" + c)[0] > 255 else 2 if encode("1" + c)[0] > 255 else 0 for c in characters])

    return zlib.compress(codepoint_classes(probe).tobytes())


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of a pre-token: the adjacent pair of least rank is merged first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    return _merge_long(piece, ranks) if len(piece) > SHORT else _merge_short(piece, ranks)


def _merge_short(piece, ranks):
    none = len(ranks) + (1 << 32)
    cuts = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cuts[i]:cuts[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[cuts[i - 1]:cuts[i + 1]], none)
    return tuple(ranks[piece[a:b]] for a, b in pairwise(cuts))


def _merge_long(piece, ranks):
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    stamp = [0] * n  # what a pair in the heap was worth when it was put there
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i:after[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stamp[i], j, stamp[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, was_i, j, was_j = heapq.heappop(heap)
        if gone[i] or gone[j] or stamp[i] != was_i or stamp[j] != was_j or after[i] != j:
            continue
        gone[j] = 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        stamp[i] += 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return tuple(out)


class Pairs:
    """The token that two adjacent tokens merge to, for many pairs at once: a table of hashed places, half of them empty at least."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[token[:k]] << 32 | ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token))
                 if token[:k] in ranks and token[k:] in ranks]
        keys, merged = np.array(found, np.int64).reshape(-1, 2).T
        self.bits = max(len(keys), 8).bit_length() + 1
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):  # the first of those at an empty place takes it, the others go on to the next one
            self.keys[place[left]] = np.where(self.keys[place[left]] < 0, keys[left], self.keys[place[left]])
            taken = self.keys[place[left]] == keys[left]
            self.merged[place[left[taken]]] = merged[left[taken]]
            left = left[~taken]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        self.letters = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes = np.empty(0, np.int32)
        self.bytes = self(np.repeat(self.letters, 256), np.tile(self.letters, 256))

    def _place(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        keys = one.astype(np.int64) << 32 | two
        place = self._place(keys)
        out = self.merged.take(place)
        there = self.keys.take(place)
        left = np.flatnonzero((there != keys) & (there >= 0))
        out[there != keys] = self.NONE
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[place[left]]
            same = there == keys[left]
            out[left[same]] = self.merged[place[left[same]]]
            left = left[~same & (there >= 0)]
        return out


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Token ids, as 32-bit integers in bytes, of pre-tokens that are no tokens themselves: like ``merge``, one merge of each in a step.

    A step has all pre-tokens that consist of the same number of tokens by then, as rows: those of so many bytes, and
    longer ones that were merged down to them.
    """
    out: list = [None] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    values, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
    of = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    width = max(of, default=0)
    rows, ids, ranks = np.zeros(0, np.int64), np.zeros((0, width), np.int32), np.zeros((0, max(width - 1, 0)), np.int32)
    while width:
        if width in of:
            text = values[starts[of[width]][:, None] + np.arange(width)].astype(np.int32)
            rows, ids = np.concatenate([rows, of[width]]), np.concatenate([ids, pairs.letters.take(text)])
            ranks = np.concatenate([ranks, pairs.bytes.take(text[:, :-1] << 8 | text[:, 1:])])
        n = len(rows)
        at = ranks.argmin(axis=1) if n and width > 1 else np.zeros(n, np.int64)
        least = ranks[np.arange(n), at] if width > 1 else np.full(n, pairs.NONE)
        done = least == pairs.NONE
        if done.any():
            data = ids[done].tobytes()
            for k, row in enumerate(rows[done].tolist()):
                out[row] = data[4 * width * k:4 * width * (k + 1)]
            rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
        n, width = len(rows), width - 1
        if not width:
            break
        each = np.arange(n)
        keep = np.ones((n, width + 1), bool)
        keep[each, at + 1] = False
        ids = ids[keep].reshape(n, width)
        ids[each, at] = least
        keep = np.ones((n, width), bool)
        keep[each, at] = False
        ranks = ranks[keep].reshape(n, width - 1)
        after, before = np.flatnonzero(at < width - 1), np.flatnonzero(at)
        ranks[after, at[after]] = pairs(least[after], ids[after, at[after] + 1])
        ranks[before, at[before] - 1] = pairs(ids[before, at[before] - 1], least[before])
    return out


class Merged(dict):
    """Token ids of pre-tokens, as 32-bit integers in bytes, merged when first met; and the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_BYTES):
        super().__init__()
        self.ranks, self.limit, self.held = ranks, limit, 0
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.known = np.zeros(len(self.sizes), bool)
        tokens: list = [b""] * len(self.sizes)
        for token, number in ranks.items():
            self.sizes[number], self.known[number], tokens[number] = len(token), True, token
        self.tokens = np.frombuffer(b"".join(tokens), np.uint8)

    @functools.cached_property
    def pairs(self) -> Pairs | None:
        """None if an id does not tell its token or a byte has none: pre-tokens are merged one at a time then."""
        plain = self.known.sum() == len(self.ranks) and all(bytes([b]) in self.ranks for b in range(256))
        return Pairs(self.ranks) if plain else None

    def _keep(self, piece: bytes, ids: bytes) -> None:
        size = ENTRY_BYTES + len(piece) + len(ids)
        self.held += size
        if self.held > self.limit:
            self.clear()
            self.held = size
        self[piece] = ids

    def __missing__(self, piece: bytes):
        ids = array("i", merge(piece, self.ranks)).tobytes()
        self._keep(piece, ids)
        return ids

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these different pre-tokens; short ones that were not met yet are merged side by side."""
        if self.pairs is None:
            return [self[p] for p in pieces]
        out = [self.get(p) for p in pieces]
        new = [k for k, ids in enumerate(out) if ids is None]
        many = []
        for k in new:
            piece = pieces[k]
            if len(piece) > SHORT or piece in self.ranks:
                out[k] = array("i", merge(piece, self.ranks)).tobytes()
            else:
                many.append(k)
        for k, ids in zip(many, merge_many([pieces[k] for k in many], self.pairs)):
            out[k] = ids
        for k in new:
            self._keep(pieces[k], out[k])
        return out

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes (binary) that the ids of each text stand for; an unknown id is an error."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise KeyError("an id without a token")
        parts = [spread(self.tokens, self.sizes, ids[k:k + TOKENS])[0] for k in range(0, len(ids), TOKENS)]
        data = np.concatenate([np.zeros(0, np.uint8), *parts])
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(self.sizes[ids])])[first], pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, ends.buffers()[1], pa.py_buffer(data)])


_KEPT: dict[str, Merged] = {}


def _worker_merged(name: str, ranks: dict[bytes, int]) -> Merged:
    """What the next tasks of the same Python worker find of a vocabulary; another vocabulary takes its place."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Merged(ranks)
    return _KEPT[name]


def encode_slice(values, offsets, classes, found: Merged) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many texts, one after the other, and the number of tokens of each."""
    cut, first = bounds(values, offsets, classes)
    data = values.tobytes()
    once, number = distinct(values, cut)
    groups = found.of([data[a:b] for a, b in zip(cut[once].tolist(), cut[once + 1].tolist())])
    own = np.fromiter(map(len, groups), np.int64, len(groups)) // 4
    ids, sizes = spread(np.frombuffer(b"".join(groups), np.int32), own, number)
    return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])


def _vocabulary(df: DataFrame, ranks_path: str):
    """The ranks, under a name by their content, and the classes of code points, for the tasks."""
    ranks = load_ranks(ranks_path)
    with open(ranks_path, "rb") as file:
        name = hashlib.sha256(file.read()).hexdigest()
    return broadcast_bytes(df.sparkSession, (name, ranks, _class_bytes()))


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", ids: str = "ids", starts: str | None = "starts",
           decoded: str | None = None, checked: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add ids array<int>, the tokens of the whole text, and starts array<int>, the byte at which each one begins.

    ``decoded`` names a column for the bytes that the ids stand for, ``checked`` one that tells whether these are the
    text's; both come from decoding the ids in the same pass. Outputs named None are left out. Ranks are read on the driver, where the
    path is, and broadcast (a vocabulary has a fixed size). A null or empty text has no tokens. Special tokens are
    ordinary text. Rows that repeat an id or a text are encoded like others. Columns named like the added ones are
    replaced; all other columns pass unchanged. Memory of a task: one slice of texts (512 KB, or one longer text); of a
    worker: one vocabulary with the pairs of its tokens and CACHE_BYTES of merged pre-tokens.
    """
    shared = _vocabulary(df, ranks_path)
    added = {ids: "array<int>", starts: "array<int>", decoded: "binary", checked: "boolean"}

    def setup():
        name, ranks, classes = shared.value
        return _worker_merged(name, ranks), np.frombuffer(zlib.decompress(classes), np.uint8)

    def run(values, offsets, state):
        found, classes = state
        tokens, counts = encode_slice(values, offsets, classes, found)
        out = [lists(tokens, counts, pa.int32())]
        if starts:
            size = found.sizes[tokens]
            ends = np.cumsum(size)
            out.append(lists((ends - size - np.repeat(offsets[:-1], counts)).astype(np.int32), counts, pa.int32()))
        if decoded or checked:
            texts = found.decoded(tokens, counts)
            if decoded:
                out.append(texts)
            if checked:
                data = values.tobytes()
                out.append(pa.array([t.as_buffer().to_pybytes() == data[a:b] for t, (a, b) in zip(texts, pairwise(offsets.tolist()))], pa.bool_()))
        return out

    return map_text(df, text_col, ", ".join(f"`{c}` {kind}" for c, kind in added.items() if c), run, setup, keep_text, SLICE)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (binary). Null ids give empty bytes; an unknown id is an error."""
    shared = _vocabulary(df, ranks_path)
    work = free_name(df, "_ids")
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])

    def run(batches):
        found = _worker_merged(*shared.value[:2])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                column = piece.column(piece.num_columns - 1)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = found.decoded(column.flatten().to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], texts], names=schema.names)

    return df.select(*[df[f"`{f.name}`"] for f in kept], F.col(ids).alias(work)).mapInArrow(run, schema)
