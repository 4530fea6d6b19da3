"""Ranked search against scoring every document, with tiny shards and intervals too."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rowmill.llm import lexical

SCHEMA = "doc_id long, text string, term string, n long, score long, item long"


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs if _terms(t)]
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts, n in held:
            m = 10 + 90 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t in set(_terms(text)) if t in counts)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(600)]
    docs += [(7, docs[7][1]), (7, "another w1 text"), (None, docs[9][1]), (700, None), (701, ""), (702, " \t-,."), (703, "été W1 日本語 w2 " * 3000), (704, docs[9][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(12)]
    return docs, items + [(None, "w1 w2"), (3, "w1"), (50, None), (51, "?!"), (52, "nowhere"), (53, "ÉTÉ été w3"), (3, "w1")]


@pytest.mark.parametrize("shard, leaf, block", [(1 << 18, 1 << 11, 1 << 20), (500, 1, 1 << 20), (900, 20, 40)])
def test_search_equals_scoring_all(spark, tables, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD_POSTINGS", shard), ("LEAF_POSTINGS", leaf), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = tables
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical.ranked_search(df, asked).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain(docs, items)


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    none = docs.limit(0)
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert lexical.ranked_search(none, items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_peaks_are_range_maxima():
    rng = np.random.default_rng(1)
    impacts = rng.integers(0, 50, 1000)
    lists = lexical.Postings(np.zeros(1000, np.int64), np.arange(1000), impacts, 1000)
    low = rng.integers(0, 999, 300)
    high = low + 1 + rng.integers(0, 1000 - low)
    assert (impacts[lists.peaks(low, high)] == [impacts[a:b].max() for a, b in zip(low, high)]).all()


def test_few_documents_are_scored(monkeypatch):
    scored = []
    put = lexical._put
    monkeypatch.setattr(lexical, "_put", lambda top, k, score, doc: (scored.append(doc), put(top, k, score, doc))[1])
    monkeypatch.setattr(lexical, "LEAF_POSTINGS", 1)
    rng = np.random.default_rng(2)
    impacts = rng.integers(1, 1000, 5000)
    lists = lexical.Postings(np.zeros(5000, np.int64), np.arange(5000), impacts, 5000)
    top = []
    lists.search(np.array([0]), np.array([3]), list(range(5000)), top, 10)
    assert sorted(s for s, _, _ in top) == (3 * np.sort(impacts)[-10:]).tolist() and len(scored) < 100
