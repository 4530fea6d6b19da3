"""Languages of texts and of their spans: scripts narrow the candidates, a Viterbi path labels the words."""

from __future__ import annotations

import functools
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmill.llm.pretokens import LETTER, codepoint_classes, codepoints
from rowmill.llm.staging import broadcast_bytes, map_text
from rowmill.llm.words import mix

# fixed values: first code point, last code point of the blocks of each script
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)], "sinhala": [(0xD80, 0xDFF)], "thai": [(0xE00, 0xE7F)], "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)], "myanmar": [(0x1000, 0x109F)], "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "ethiopic": [(0x1200, 0x137F)], "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = list(SCRIPTS)
#: Documents of each language that the model learns from (on average: a hash decides), hashed trigrams, pseudo-count,
#: the share of a language's letters that makes a script one of its own, and the price of a switch in nats.
TRAIN_ROWS, BITS, PRIOR, SHARE, SWITCH = 2000, 15, 0.5, 0.02, 14.0
UNKNOWN = "und"


@functools.cache
def _letters() -> bytes:
    """Script number of every letter (1 upwards, 255: another script; 0: no letter), compressed."""
    kind = np.where(codepoint_classes() == LETTER, 255, 0).astype(np.uint8)
    for number, name in enumerate(NAMES, 1):
        for first, last in SCRIPTS[name]:
            part = kind[first:last + 1]
            part[part > 0] = number
    return zlib.compress(kind.tobytes())


def _small() -> np.ndarray:
    """Lower case of the code points of the first plane that have one of a single character."""
    out = np.arange(0x10000, dtype=np.uint32)
    for point in range(0x10000):
        low = chr(point).lower()
        if len(low) == 1 and ord(low) < 0x10000 and unicodedata.category(chr(point)) in ("Lu", "Lt"):
            out[point] = ord(low)
    return out


def _setup():
    return np.frombuffer(zlib.decompress(_letters()), np.uint8), _small()


def letter_words(values, offsets, tables, bits: int = BITS):
    """Words (runs of letters): hashed trigrams of all letters, script of each letter, first letter of each word, first
    word of each text, and start and end of each word in code points of its text."""
    scripts, small = tables
    points, starts = codepoints(values)
    begin = np.searchsorted(starts, offsets)
    n = len(points)
    kind = scripts[points] if n else np.zeros(0, np.uint8)
    letter = kind > 0
    first = np.zeros(n + 1, bool)
    first[begin] = True
    at = np.flatnonzero(letter)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, kind[at], empty, np.zeros(len(offsets), np.int64), empty, empty
    low = np.where(points < 0x10000, small[np.minimum(points, 0xFFFF)], points).astype(np.uint64)
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    opens = letter & (~before | first[:-1])
    after = np.zeros(n, bool)
    after[:-1] = letter[1:]
    closes = letter & (~after | first[1:])
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[opens], right[closes] = 0, 0
    grams = mix((left[at] << np.uint64(42)) | (low[at] << np.uint64(21)) | right[at]) >> np.uint64(64 - bits)
    word_at = np.flatnonzero(opens)
    word_end = np.flatnonzero(closes) + 1
    doc_first = np.searchsorted(word_at, begin)
    base = np.repeat(begin[:-1], np.diff(doc_first))
    return grams.astype(np.int64), kind[at], np.searchsorted(at, word_at), doc_first, word_at - base, word_end - base


@dataclass
class LanguageModel:
    langs: list
    weights: np.ndarray  # [trigrams, languages] log probabilities
    allowed: np.ndarray  # [scripts, languages] whether a language is written in a script


def train(docs: DataFrame, use: Column | None = None, rows: int = TRAIN_ROWS, bits: int = BITS) -> LanguageModel:
    """Trigram probabilities of each language from about ``rows`` documents of it, drawn by a hash of the text and id.

    Null languages and texts teach nothing. Counts are summed by Spark; what comes to the driver is bounded by
    languages times hashed trigrams.
    """
    known = docs.where("lang is not null and text is not null")
    if use is not None:
        known = known.where(use)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros((256, 0), bool))
    share = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / sizes[lang]))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def run(values, offsets, tables):
        grams, kind, word_first, doc_first, _, _ = letter_words(values, offsets, tables, bits)
        ends = np.append(word_first, len(grams))[doc_first]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            found, n = np.unique(np.concatenate([grams[a:b], kind[a:b].astype(np.int64) + (1 << bits)]), return_counts=True)
            out.append(list(zip(found.tolist(), n.tolist())))
        return [pa.array([[{"f": f, "n": n} for f, n in x] for x in out], pa.list_(pa.struct([("f", pa.int64()), ("n", pa.int64())])))]

    counted = map_text(drawn, "text", "counts array<struct<f: long, n: long>>", run, _setup).select("lang", F.inline("counts"))
    table = counted.groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    number = {lang: k for k, lang in enumerate(langs)}
    column = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    f, n = table["f"].to_numpy(), table["n"].to_numpy()
    counts, scripts = np.zeros((1 << bits, len(langs))), np.zeros((256, len(langs)))
    gram = f < (1 << bits)
    np.add.at(counts, (f[gram], column[gram]), n[gram])
    np.add.at(scripts, (f[~gram] - (1 << bits), column[~gram]), n[~gram])
    weights = np.log((counts + PRIOR) / (counts.sum(0) + PRIOR * (1 << bits)))
    return LanguageModel(langs, weights.astype(np.float32), scripts >= SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of labels for the words of each text, all texts in step: the longest ones stay until the end.

    ``scores`` has a row per word; a switch of labels between words costs ``switch``.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begins, length = first[:-1][order], counts[order]
    n, labels = scores.shape
    own = np.arange(labels)
    back = np.empty((n, labels), np.int16)
    value = np.zeros((len(order), labels))
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), "left")  # texts with more than t words
    for t in range(most):
        a = active[t]
        at = begins[:a] + t
        now = value[:a]
        if t:
            best = now.argmax(1)
            jump = now[np.arange(a), best] - switch
            leave = now < jump[:, None]
            back[at] = np.where(leave, best[:, None], own)
            now = np.where(leave, jump[:, None], now)
        value[:a] = now + scores[at]
    path = np.empty(n, np.int16)
    state = value.argmax(1)
    for t in range(most - 1, -1, -1):
        a = active[t]
        at = begins[:a] + t
        path[at] = state[:a]
        if t:
            state[:a] = back[at, state[:a]]
    return path


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and spans array<struct<start, end, lang>> (code points) from the whole text.

    A word is a run of letters. Its candidates are the languages that are written in its first letter's script (all,
    if none is); the score of a candidate is the sum of its trigrams' log probabilities. lang_pred is the language
    whose spans hold most letters, of equal ones the first by name, and score is its share of all letters. A null
    text, or one without a letter, and any text where no language was learned, is ``und`` with score 0 and no spans.
    Added columns replace columns of the same name.
    """
    shared = broadcast_bytes(df.sparkSession, model)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(values, offsets, tables):
        model = shared.value
        grams, script, word_first, doc_first, starts, ends = letter_words(values, offsets, tables)
        docs, k = len(offsets) - 1, len(model.langs)
        if not k or not len(grams):
            return [pa.array([UNKNOWN] * docs), pa.array(np.zeros(docs)), pa.array([[]] * docs, pa.list_(kind))]
        scores = np.add.reduceat(model.weights[grams], word_first, axis=0)
        allowed = model.allowed[script[word_first]]
        scores = np.where(allowed | ~allowed.any(1, keepdims=True), scores, scores - 1e4)
        path = viterbi(scores, doc_first)
        counts = np.diff(doc_first)
        doc = np.repeat(np.arange(docs), counts)
        letters = np.diff(np.append(word_first, len(grams)))
        mass = np.bincount(doc * k + path, letters, docs * k).reshape(docs, k)
        total = mass.sum(1)
        best = mass.argmax(1)
        names = np.array(model.langs, object)
        pred = np.where(total > 0, names[best], UNKNOWN)
        opens = np.ones(len(path), bool)
        opens[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(opens)
        tail = np.append(head[1:], len(path)) - 1
        spans = pa.StructArray.from_arrays([pa.array(starts[head].astype(np.int32)), pa.array(ends[tail].astype(np.int32)),
                                            pa.array(names[path[head]].tolist(), pa.string())], fields=list(kind))
        places = np.concatenate([[0], np.cumsum(np.bincount(doc[head], minlength=docs))]).astype(np.int32)
        return [pa.array(pred.tolist(), pa.string()), pa.array(mass.max(1) / np.maximum(total, 1)),
                pa.ListArray.from_arrays(pa.array(places), spans)]

    return map_text(df, text_col, "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>", run, _setup)
