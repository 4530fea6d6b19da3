"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmill.llm.labelled import known_labels, sample
from rowmill.llm.staging import broadcast_bytes, lists, map_text
from rowmill.llm.words import PUNCTUATION, lowered, slice_hashes, word_bounds

#: Bounds of the sample that the model is fitted on.
TRAIN_ROWS, TRAIN_CHARS = 6000, 40_000
#: Slots of the hash table of embeddings, their size, filter widths and filters of each width.
SLOT_BITS, SIZE, WIDTHS, FILTERS = 20, 8, (1, 2, 3), 8
#: A word needs so many texts of the sample for a row of its own; all other words share the row of zeros.
SEEN = 3
PASSES, BATCH, RATE = 6, 32, 0.05
#: Thresholds that are tried.
GRID = np.round(np.linspace(0.02, 0.98, 49), 2)
#: Labelled texts of a language that are needed for a threshold of its own.
CALIBRATE = 50


@dataclass
class ConvolutionModel:
    marks: np.ndarray  # upper half of the hash that owns a slot
    rows: np.ndarray  # its row of the embeddings; 0 is the row of unknown words
    embeddings: np.ndarray
    filters: dict  # width: [width, SIZE, FILTERS]
    shift: np.ndarray  # of each filter, by width
    out: np.ndarray
    bias: float

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        return np.where(self.marks[slot] == (hashes >> np.uint64(32)).astype(np.uint32), self.rows[slot], 0)


def word_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each text (runs of letters and digits) and of their first four bytes; words per text."""
    low = lowered(values)
    starts, ends, first = word_bounds(low, offsets, PUNCTUATION)
    word, stem = slice_hashes(low, starts, ends), slice_hashes(low, starts, np.minimum(starts + 4, ends))
    return np.stack([word, stem ^ np.uint64(0x94D049BB133111EB)], axis=1), np.diff(first)


def _conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, counts: np.ndarray):
    """Outputs of one filter width at every word (minus infinity where the window leaves the text)."""
    width, n = len(w), len(x)
    y = x @ w[0] + b
    for j in range(1, width):
        y[:n - j] += x[j:] @ w[j]
    if width > 1:
        ends = np.cumsum(counts)
        for j in range(1, width):
            y[(ends - j)[counts >= j]] = -np.inf
    return y


def _pooled(y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maximum over each text, 0 at least (the rectifier after pooling is the same as before it)."""
    out = np.zeros((len(counts), y.shape[1]), y.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        begins = (np.cumsum(counts) - counts)[full]
        out[full] = np.maximum(np.maximum.reduceat(y, begins, axis=0), 0)
    return out


def fit(hashes: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 11) -> ConvolutionModel:
    """Fit embeddings, filters and the output layer by AdaGrad on the loss of both labels, equally weighted.

    The first component of an embedding starts at the smoothed log odds of the word's texts, and one filter of
    width 1 reads it; all else starts at small random values. Only windows that win the pooling get a gradient.
    """
    rng = np.random.default_rng(seed)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(np.stack([np.tile(doc, 2).astype(np.uint64), hashes.T.ravel()]), axis=1)
    known, place, seen = np.unique(pairs[1], return_inverse=True, return_counts=True)
    toxic = np.bincount(place, labels[pairs[0].astype(np.int64)], len(known))
    n1 = labels.sum()
    n0 = len(labels) - n1
    odds = np.log((toxic + 1) / (n1 + 2)) - np.log((seen - toxic + 1) / (n0 + 2))
    keep = np.flatnonzero(seen >= SEEN)
    keep = keep[np.argsort(seen[keep], kind="stable")]  # the more frequent word owns a slot that two share
    marks, rows = np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(1 << SLOT_BITS, np.int32)
    slot = (known[keep] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    marks[slot], rows[slot] = (known[keep] >> np.uint64(32)).astype(np.uint32), np.arange(1, len(keep) + 1)
    table = rng.normal(0, 0.05, (len(keep) + 1, SIZE)).astype(np.float32)
    table[1:, 0] = np.clip(odds[keep], -4, 4) / 4
    table[0] = 0
    filters = {w: rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    filters[WIDTHS[0]][0, :, 0] = 0
    filters[WIDTHS[0]][0, 0, 0] = 2.0
    model = ConvolutionModel(marks, rows, table, filters, np.zeros((len(WIDTHS), FILTERS), np.float32),
                             rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    model.out[0] = 1.0
    if not n1 or not n0:
        model.out[:], model.bias = 0, 4.0 if n1 else -4.0
        return model
    ids = model.lookup(hashes)
    ends = np.concatenate([[0], np.cumsum(counts)])
    weight = np.where(labels == 1, len(labels) / (2 * n1), len(labels) / (2 * n0))
    past = {"table": np.full(table.shape, 1e-6, np.float32), "out": np.full(len(model.out), 1e-6), "bias": 1e-6,
            "shift": np.full(model.shift.shape, 1e-6), **{w: np.full(f.shape, 1e-6) for w, f in filters.items()}}

    def update(name, value, g):
        past[name] += g * g
        value -= (RATE * g / np.sqrt(past[name])).astype(np.float32)

    for _ in range(PASSES):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            some = np.sort(order[low:low + BATCH])
            n = counts[some]
            words = np.concatenate([ids[ends[i]:ends[i + 1]] for i in some])
            x = table[words[:, 0]] + table[words[:, 1]]
            begins = np.cumsum(n) - n
            tops, pools = [], []
            for k, w in enumerate(WIDTHS):
                y = _conv(x, filters[w], model.shift[k], n)
                top = np.zeros((len(some), FILTERS), np.int64)
                for d in np.flatnonzero(n):
                    top[d] = begins[d] + y[begins[d]:begins[d] + n[d]].argmax(axis=0)
                value = np.where(n[:, None] > 0, y[np.minimum(top, max(len(y) - 1, 0)), np.arange(FILTERS)], 0) if len(y) else np.zeros(top.shape)
                tops.append(top)
                pools.append(np.maximum(value, 0))
            pooled = np.hstack(pools)
            p = _sigmoid(pooled @ model.out + model.bias)
            g = (p - labels[some]) * weight[some] / len(some)
            back = (g[:, None] * model.out[None, :]) * (pooled > 0)
            update("out", model.out, g @ pooled)
            past["bias"] += g.sum() ** 2
            model.bias -= RATE * g.sum() / np.sqrt(past["bias"])
            moved = {}
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS:(k + 1) * FILTERS]
                d, f = np.nonzero(part)
                at, amount = tops[k][d, f], part[d, f]
                gw = np.zeros(filters[w].shape)
                gs = np.zeros(FILTERS)
                np.add.at(gs, f, amount)
                for j in range(w):
                    np.add.at(gw[j].T, f, amount[:, None] * x[at + j])
                    moved.setdefault("rows", []).append(words[at + j].ravel())
                    moved.setdefault("by", []).append(np.repeat(amount[:, None] * filters[w][j][:, f].T, 2, axis=0))
                update(w, filters[w], gw)
                past["shift"][k] += gs * gs
                model.shift[k] -= RATE * gs / np.sqrt(past["shift"][k])
            touched, back_to = np.unique(np.concatenate(moved["rows"]), return_inverse=True)
            grad = np.zeros((len(touched), SIZE))
            np.add.at(grad, back_to, np.concatenate(moved["by"]))
            grad[touched == 0] = 0
            past["table"][touched] += grad * grad
            table[touched] -= RATE * 0.5 * grad / np.sqrt(past["table"][touched])
    return model


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scores(model: ConvolutionModel, hashes: np.ndarray, counts: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Probability of the toxic label of each text; a long text is convolved in overlapping blocks of words."""
    ids, ends = model.lookup(hashes), np.concatenate([[0], np.cumsum(counts)])
    pooled = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
    overlap, low = max(WIDTHS) - 1, 0
    while low < len(counts):
        if counts[low] > block:
            spans = [(a, min(a + block + overlap, ends[low + 1])) for a in range(int(ends[low]), int(ends[low + 1]), block)]
            high, groups = low + 1, [(np.array([b - a]), a, b) for a, b in spans]
        else:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + block, "right")) - 1)
            groups = [(counts[low:high], ends[low], ends[high])]
        for n, a, b in groups:
            x = model.embeddings[ids[a:b, 0]] + model.embeddings[ids[a:b, 1]]
            found = np.hstack([_pooled(_conv(x, model.filters[w], model.shift[k], n), n) for k, w in enumerate(WIDTHS)])
            pooled[low:high] = np.maximum(pooled[low:high], found)
        low = high
    return _sigmoid(pooled @ model.out + model.bias).astype(np.float64)


def set_aside() -> Column:
    """The fifth of the documents that calibrates thresholds and that no model is fitted on."""
    return F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, use: Column | None = None) -> ConvolutionModel:
    """Fit on a bounded sample of the labelled documents that are not set aside."""
    def run(values, offsets, _):
        hashes, counts = word_ids(values, offsets)
        return [lists(hashes.ravel().view(np.int64), 2 * counts, pa.int64())]

    use = ~set_aside() if use is None else use & ~set_aside()
    drawn = sample(docs, labels, label, rows, "hashes array<long>", run, TRAIN_CHARS, use, (), [0, 1])
    column = drawn["hashes"].combine_chunks() if len(drawn) else pa.array([], pa.list_(pa.int64()))
    flat = column.values.to_numpy().view(np.uint64).reshape(-1, 2)
    counts = np.diff(column.offsets.to_numpy()) // 2 if len(drawn) else np.zeros(0, np.int64)
    return fit(flat, counts, drawn["label"].to_numpy().astype(np.int64))


def calibrate(scored: DataFrame, labels: DataFrame, label: str = "toxic", use: Column | None = None) -> dict:
    """Thresholds by language (None for all others) from all labelled documents that are set aside; ``scored`` has doc_id, lang, score.

    The threshold of a language maximizes F1 on its documents (of equal ones the nearest to 0.5); languages with fewer than
    CALIBRATE of them, or one label only, share that of all. The counts at every step of the grid are summed by Spark.
    """
    known = known_labels(labels, label).where(set_aside()).where(F.col("label").isin(0, 1))
    if use is not None:
        known = known.where(use)
    above = lambda t: F.col("score") >= F.lit(float(t))
    counts = scored.join(known, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"),
        *[F.count_if(above(t)).alias(f"f{i}") for i, t in enumerate(GRID)],
        *[F.count_if(above(t) & (F.col("label") == 1)).alias(f"h{i}") for i, t in enumerate(GRID)]).collect()  # one row per language
    table = np.array([r[1:] for r in counts], np.int64).reshape(len(counts), 2 + 2 * len(GRID))
    found = {None: _threshold(table.sum(axis=0))}
    for row, sums in zip(counts, table):
        if row["lang"] is not None and sums[0] >= CALIBRATE and 0 < sums[1] < sums[0]:
            found[row["lang"]] = _threshold(sums)
    return found


def _threshold(sums: np.ndarray) -> float:
    """From documents, toxic ones, and at each step those that reach it and the toxic ones of these."""
    n, toxic, (flagged, hits) = sums[0], sums[1], sums[2:].reshape(2, -1)
    if not 0 < toxic < n:
        return 0.5
    f1 = 2 * hits / (flagged + toxic)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[best[np.abs(GRID[best] - 0.5).argmin()]])


def toxicity(df: DataFrame, model: ConvolutionModel, text_col: str = "text") -> DataFrame:
    """Add score, the probability that a text is toxic, from the whole text alone.

    A null or empty text, or one without words, gets the score of no word. The column replaces one of its name.
    """
    shared = broadcast_bytes(df.sparkSession, model)

    def run(values, offsets, _):
        return [pa.array(scores(shared.value, *word_ids(values, offsets)))]

    return map_text(df, text_col, "score double", run)
