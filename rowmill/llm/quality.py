"""Quality by ordinal regression: shared weights of hashed text features and ordered thresholds between grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from rowmill.llm.labelled import grades, sample
from rowmill.llm.staging import broadcast_bytes, lists, map_text
from rowmill.llm.words import lowered, slice_hashes, word_bounds

#: Bounds of the sample that the model is fitted on, and the number of hashed features.
TRAIN_ROWS, TRAIN_CHARS, BITS = 6000, 60_000, 18
PASSES, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-4


@dataclass
class OrdinalModel:
    """P(grade <= grades[k]) = sigmoid(thresholds[k] - score); thresholds ascend."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) of each score, for all grades but the last."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.above(scores) @ np.diff(self.grades)

    def tail(self, scores: np.ndarray, least: float) -> np.ndarray:
        """P(grade >= least)."""
        k = int(np.searchsorted(self.grades, least))
        if k == 0:
            return np.ones(len(scores))
        return self.above(scores)[:, k - 1] if k < len(self.grades) else np.zeros(len(scores))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(values: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words of each text and their number: the word without case, how it begins and ends as
    written (case and signs show there), and whether it repeats the word before."""
    starts, ends, first = word_bounds(values, offsets)
    low = lowered(values)
    word = slice_hashes(low, starts, ends)
    again = np.zeros(len(word), np.uint64)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = 0
    kinds = [word, slice_hashes(values, np.maximum(starts, ends - 2), ends), slice_hashes(values, np.maximum(starts, ends - 3), ends),
             slice_hashes(values, starts, np.minimum(starts + 3, ends)), again]
    shift = np.uint64(64 - bits + 3)
    room = np.uint64(1 << (bits - 3))
    out = np.empty((len(word), len(kinds)), np.int32)
    for k, x in enumerate(kinds):
        out[:, k] = (x if k == 4 else x >> shift) + np.uint64(k) * room
    return out.ravel(), np.diff(first) * len(kinds)


def fit(flat: np.ndarray, counts: np.ndarray, labels: np.ndarray, levels: list[int], bits: int = BITS, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood by AdaGrad over the mean feature weight of each text; equal weight for every grade."""
    levels = np.asarray(levels, float)
    m = len(levels) - 1
    weights, square = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    base, gaps = -(m - 1) / 2.0, np.zeros(max(m - 1, 0))  # thresholds: base, then steps of exp(gap)
    slope = np.full(1 + len(gaps), 1e-8)
    place = np.searchsorted(levels, labels)
    share = np.bincount(place, minlength=m + 1).astype(float)
    weight = (len(place) / np.maximum(share, 1) / (m + 1))[place]
    ends = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(seed)
    for _ in range(PASSES if m > 0 else 0):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            some = order[low:low + BATCH]
            ids = np.concatenate([flat[ends[i]:ends[i + 1]] for i in some]) if len(some) else flat[:0]
            n = counts[some]
            doc = np.repeat(np.arange(len(some)), n)
            part = 10.0 / np.maximum(n, 1)
            score = np.bincount(doc, weights[ids], len(some)) * part
            cuts = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            below = np.hstack([np.zeros((len(some), 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((len(some), 1))])
            density = below * (1 - below)
            k, rows = place[some], np.arange(len(some))
            chance = np.maximum(below[rows, k + 1] - below[rows, k], 1e-9)
            w = weight[some] / len(some)
            upper, lower = w * density[rows, k + 1] / chance, w * density[rows, k] / chance
            move = np.bincount(ids, ((upper - lower) * part)[doc], 1 << bits)
            used = np.unique(ids)
            g = move[used] + DECAY * weights[used] / len(some)
            square[used] += g * g
            weights[used] -= RATE * g / np.sqrt(square[used])
            cut = np.zeros(m)
            np.subtract.at(cut, k[k < m], upper[k < m])
            np.add.at(cut, k[k > 0] - 1, lower[k > 0])
            step = np.concatenate([[cut.sum()], np.cumsum(cut[::-1])[::-1][1:] * np.exp(gaps)])
            slope += step * step
            step = RATE * step / np.sqrt(slope)
            base, gaps = base - step[0], gaps - step[1:]
    cuts = base + np.concatenate([[0], np.cumsum(np.exp(gaps))]) if m > 0 else np.zeros(0)
    return OrdinalModel(levels, weights.astype(np.float32), cuts)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, use: Column | None = None) -> OrdinalModel:
    """Fit on a bounded sample of the labelled documents (``rows``, each of TRAIN_CHARS characters at most).

    Grades are the distinct labels, in order. Without labelled documents, or with one grade, every text gets the
    only (or the grade 0).
    """
    levels = grades(labels, label)

    def run(values, offsets, _):
        flat, counts = features(values, offsets)
        return [lists(flat, counts, pa.int32())]

    drawn = sample(docs, labels, label, rows, "features array<int>", run, TRAIN_CHARS, use, values=levels)
    column = drawn["features"].combine_chunks()
    if not len(drawn):
        return OrdinalModel(np.array(levels[:1] or [0.0], float), np.zeros(1 << BITS, np.float32), np.zeros(0))
    counts = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py():]
    seen = np.unique(drawn["label"].to_numpy())
    return fit(flat, counts, drawn["label"].to_numpy(), seen.tolist())


def grade(df: DataFrame, model: OrdinalModel, text_col: str = "text", least: float | None = None,
          chance: float = 0.5) -> DataFrame:
    """Add expected_grade, tail_probability (that the grade is ``least`` or more; by default the highest) and selected.

    Whole texts are scored. A null or empty text, or one without words, has no features: its score is 0, between
    the thresholds as they are. Added columns replace columns of the same name.
    """
    shared = broadcast_bytes(df.sparkSession, model)
    least = float(model.grades[-1]) if least is None else least

    def run(values, offsets, _):
        model = shared.value
        flat, counts = features(values, offsets)
        sums = np.concatenate([[0.0], np.cumsum(model.weights[flat], dtype=np.float64)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        scores = 10.0 * (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(counts, 1)
        tail = model.tail(scores, least)
        return [pa.array(model.expected(scores)), pa.array(tail), pa.array(tail >= chance)]

    return map_text(df, text_col, "expected_grade double, tail_probability double, selected boolean", run)
