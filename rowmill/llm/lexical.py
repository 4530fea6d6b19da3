"""Ranked lexical search: best-first document intervals, bounded by range maxima of posting lists."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowmill.llm.staging import broadcast_bytes, lists, map_text, stage
from rowmill.llm.words import PUNCTUATION, lowered, slice_hashes, word_bounds

#: Pairs of item and term that are searched in one pass over the documents (8 bytes each are broadcast).
BLOCK_TERMS = 1 << 20
#: Postings of a shard that a task indexes at a time (one document more where it crosses the bound), and postings of
#: an interval whose documents are all scored at once.
SHARD_POSTINGS, LEAF_POSTINGS = 1 << 18, 1 << 11
#: Fixed values of the score: the parts of a document's length norm.
FLAT, SLOPE = 10, 90


def term_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (runs of ASCII letters, digits and longer characters, A-Z lower-cased) and how many each text has."""
    starts, ends, first = word_bounds(values, offsets, PUNCTUATION)
    return slice_hashes(lowered(values), starts, ends), np.diff(first)


class Postings:
    """Posting lists of a shard: by term the documents' positions in order and their impacts, with sparse tables that
    give the place of the largest impact of any stretch of a list."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.n_docs = docs[order].astype(np.int64), impacts[order], n_docs
        self.terms, begins = np.unique(terms[order], return_index=True)
        self.begins = np.append(begins, len(order)).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.begins)) * n_docs + self.docs
        longest = int(np.diff(self.begins).max()) if len(self.terms) else 0
        self.best = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.best) - 1) <= longest:
            half, below = 1 << (len(self.best) - 1), self.best[-1]
            a, b = below[:-half], below[half:]
            self.best.append(np.where(self.impacts[b] > self.impacts[a], b, a))

    def peaks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the largest impacts of stretches, none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            some = level == k
            a, b = self.best[k][low[some]], self.best[k][high[some] - (1 << int(k))]
            out[some] = np.where(self.impacts[b] > self.impacts[a], b, a)
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, ids, top: list, k: int) -> None:
        """Put the best documents into ``top``, a heap of at most k (score, rank of the id, id)."""
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        if not len(at):
            return
        ticket = count()
        heap: list = []

        def offer(number, low, high, weight):
            some = low < high
            if not some.all():
                number, low, high, weight = number[some], low[some], high[some], weight[some]
            if not len(low):
                return
            peak = self.peaks(low, high)
            gains = weight * self.impacts[peak]
            bound = int(gains.sum())
            if len(top) < k or bound >= top[0][0]:
                heapq.heappush(heap, (-bound, next(ticket), number, low, high, weight, int(self.docs[peak[gains.argmax()]])))

        offer(at, self.begins[at], self.begins[at + 1], weights)
        while heap:
            bound, _, number, low, high, weight, middle = heapq.heappop(heap)
            if len(top) == k and -bound < top[0][0]:
                return
            sizes = high - low
            total = int(sizes.sum())
            if total <= LEAF_POSTINGS:
                ends = np.cumsum(sizes)
                place = np.arange(total) - np.repeat(ends - sizes - low, sizes)
                docs = self.docs[place]
                first = int(docs.min())
                scores = np.bincount(docs - first, np.repeat(weight, sizes) * self.impacts[place])  # whole numbers below 2^53
                able = np.flatnonzero(scores >= (top[0][0] if len(top) == k else 1))
                for d in able[np.argsort(-scores[able], kind="stable")].tolist():
                    _put(top, k, int(scores[d]), ids[first + d])
                continue
            wanted = number * self.n_docs + middle
            cut = np.searchsorted(self.keys, wanted)
            found = cut < high
            found[found] = self.keys[cut[found]] == wanted[found]
            _put(top, k, int((weight[found] * self.impacts[cut[found]]).sum()), ids[middle])
            offer(number, low, cut, weight)
            offer(number, cut + found, high, weight)


def _put(top: list, k: int, score: int, doc) -> None:
    """Higher scores first, equal ones by ascending id, a null id last."""
    if score <= 0:
        return
    entry = (score, -math.inf if doc is None else -doc, doc)
    if len(top) < k:
        heapq.heappush(top, entry)
    elif entry[:2] > top[0][:2]:
        heapq.heapreplace(top, entry)


@dataclass
class Items:
    """Items of a block: their ids, and by item the numbers of its terms among the sorted hashes of all."""

    ids: list
    begins: np.ndarray
    terms: np.ndarray
    hashes: np.ndarray


def _items(rows: pa.Table) -> Items:
    column = rows.column("hashes").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().view(np.uint64)
    hashes, number = np.unique(flat, return_inverse=True)
    return Items(rows.column("id").to_pylist(), np.concatenate([[0], np.cumsum(sizes)]), number.astype(np.int64), hashes)


def _forward(docs: DataFrame, items: Items) -> DataFrame:
    """id, n (all terms) and the items' terms that a document holds, with their occurrences."""
    shared = broadcast_bytes(docs.sparkSession, items.hashes)

    def run(values, offsets, known):
        hashes, counts = term_hashes(values, offsets)
        at = np.searchsorted(known, hashes)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == hashes[hit]
        doc = np.repeat(np.arange(len(counts)), counts)[hit]
        pairs, times = np.unique(doc * max(1, len(known)) + at[hit], return_counts=True)
        doc, term = np.divmod(pairs, max(1, len(known)))
        sizes = np.bincount(doc, minlength=len(counts))
        return [pa.array(counts.astype(np.int64)), lists(term.astype(np.int32), sizes, pa.int32()), lists(times.astype(np.int64), sizes, pa.int64())]

    return map_text(docs, "text", "n long, terms array<int>, times array<long>", run, lambda: shared.value).select("id", "n", "terms", "times")


def _best(forward: DataFrame, items: Items, k: int) -> DataFrame:
    """The best documents of each task for each item; nothing else leaves a task."""
    spark = forward.sparkSession
    docs, terms = forward.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(max(1, len(items.hashes)), np.int64)
    held = forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row per term of the block
    weights[held.column("t").to_numpy()] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in held.column("df").to_pylist()]
    shared = broadcast_bytes(spark, (items, weights, docs, terms))

    def search(parts, tops, items, weights, docs, terms):
        ids = sum((p[0] for p in parts), [])
        n, sizes = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
        term, times = (np.concatenate([p[j] for p in parts]).astype(np.int64) for j in (3, 4))
        if not len(term):
            return
        norm = FLAT + SLOPE * n * docs // terms
        doc = np.repeat(np.arange(len(n)), sizes)
        shard = Postings(term, doc, 1_000_000_000 * times // (1000 * times + 8 * norm[doc]), len(n))
        for top, a, b in zip(tops, items.begins, items.begins[1:]):
            own = items.terms[a:b]
            shard.search(own, weights[own], ids, top, k)

    def run(batches):
        items, *rest = shared.value
        tops: list[list] = [[] for _ in items.ids]
        parts, held = [], 0
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            term, times = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            start = 0
            while start < len(ids):
                room = ends[start] + SHARD_POSTINGS - held
                stop = min(len(ids), max(start + 1, int(np.searchsorted(ends, room, "right")) - 1))
                a, b = ends[start], ends[stop]
                parts.append((ids[start:stop], n[start:stop], np.diff(ends[start:stop + 1]), term[a:b], times[a:b]))
                held += int(b - a)
                start = stop
                if held >= SHARD_POSTINGS or start < len(ids):
                    search(parts, tops, items, *rest)
                    parts, held = [], 0
        if parts:
            search(parts, tops, items, *rest)
        out = [(i, doc, score) for i, top in enumerate(tops) for score, _, doc in top]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                          pa.array([o[2] for o in out], pa.int64())], names=["item", "doc_id", "score"])

    return forward.where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item, by whole numbers alone.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))) for N documents with terms, of which df hold it; a
    document of n terms has the norm m = 10 + 90 n N div L (L: all terms); its score sums w (10^9 tf div (1000 tf + 8 m))
    over the item's distinct terms. Equal scores come by ascending doc_id.

    Items are taken in blocks of about BLOCK_TERMS pairs of item and term, each with one pass over the texts: it counts
    the documents' terms and keeps those of the block's items (a table in the shared folder). A task indexes shards of
    SHARD_POSTINGS postings: lists of positions and impacts with sparse tables of range maxima. An item's search
    begins with all documents of a shard; the interval of the largest bound (the sum of its terms' range maxima) is
    split at the document of the largest single impact, which is scored, or scored whole when it is small; it ends
    where no interval can reach the k best so far, which a task carries from shard to shard. A task returns k rows
    per item, of which Spark keeps the first k before and after the shuffle.

    Terms are compared by 64-bit hashes. A null or empty text has no terms: such a document is in no result and not in
    N, such an item has none. Rows that repeat an id or a text are documents (items) of their own; a null doc_id comes
    last among equal scores. Empty tables give empty results. Other columns have no effect.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def distinct(values, offsets, _):
        hashes, counts = term_hashes(values, offsets)
        sets = [np.unique(h) for h in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return [lists(flat.view(np.int64), [len(s) for s in sets], pa.int64())]

    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    asked = stage(map_text(asked, "text", "hashes array<long>", distinct).select("id", "hashes").where(F.size("hashes") > 0).withColumn(
        "number", F.monotonically_increasing_id()), "items")
    pairs = asked.agg(F.sum(F.size("hashes"))).first()[0] or 0
    blocks = math.ceil(pairs / BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        known = _items(asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("id", "hashes").orderBy("number").toArrow())
        if not known.ids:
            continue
        best = _best(stage(_forward(texts, known), "forward"), known, k)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = stage(best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "best")
        names = spark.createDataFrame([*enumerate(known.ids)], "item long, item_id long")
        out = out.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
