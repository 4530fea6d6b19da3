"""Near-duplicate vectors in several shards and blocks: whole results, and no task that holds more than its shard."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import types as T

from rowmill.llm import hnsw


@pytest.fixture()
def small_shards(monkeypatch):
    """Four or five shards of each label, two or three blocks of queries."""
    for name, value in (("LEAST_SIZE", 8), ("SHARD_FLOATS", 8 * 45), ("BLOCK_SHARDS", 2)):
        monkeypatch.setattr(hnsw, name, value)


def _vectors():
    rng = np.random.default_rng(21)
    base = rng.normal(size=(30, 8))
    x = np.array([base[k % 30] + (0 if k % 5 == 0 else 0.12) * rng.normal(size=8) for k in range(360)], np.float32)
    return [(k, x[k].tolist(), k % 2, k) for k in range(360)], x.astype(np.float64)


def _expected(x):
    n = len(x)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    link = (x @ x.T >= 0.93) & (np.arange(n)[:, None] % 2 == np.arange(n)[None, :] % 2) & ~np.eye(n, dtype=bool)
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[k], *comp[link[k]]]) for k in range(n)])
        if (new == comp).all():
            return list(zip(range(n), link.sum(1).tolist(), comp.tolist()))
        comp = new


@pytest.mark.parametrize("kind", ["float", "double"])
def test_shards_and_blocks_give_whole_links(spark, small_shards, kind):
    rows, x = _vectors()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, held int").repartition(5)
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in hnsw.near_vectors(df).collect())
    assert got == _expected(x)


def test_no_row_carries_a_shard(spark, small_shards, monkeypatch):
    """Graphs and vectors of a shard were one row, copied once per block: executors ran out of memory."""
    kinds = []
    stage = hnsw.stage

    def spied(df, *rest):
        kinds.extend(f.dataType for f in df.schema.fields)
        return stage(df, *rest)

    monkeypatch.setattr(hnsw, "stage", spied)
    rows, x = _vectors()
    df = spark.createDataFrame(rows[:200], "vec_id long, embedding array<float>, label int, held int")
    assert hnsw.near_vectors(df).count() == 200
    assert kinds and T.BinaryType() not in kinds and T.ArrayType(T.LongType()) not in kinds


def test_pairs_of_a_dense_shard_are_not_held_at_once():
    rng = np.random.default_rng(22)
    n = 3000
    x = hnsw._unit(rng.normal(size=8) + 0.02 * rng.normal(size=(n, 8)))
    shard = hnsw.Shard(np.arange(n) * 3, np.ones(n, np.int64), x, 0.93)
    tracemalloc.start()
    try:
        counts, first = shard.ask(np.arange(n) * 3, x)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (counts == n - 1).all() and (first >= 0).all() and not shard.up.any()
    assert peak < 16 * n * n / 2  # ids of all pairs
    found = list(shard.graph.pairs(x, 0.93, shard.beam, np.arange(n)))
    assert sum(len(i) for i, _ in found) == n * n and max(len(i) for i, _ in found) <= hnsw.HELD_PAIRS


def test_groups_that_span_batches_and_share_them():
    """Rows of one group come in several Arrow batches, and one batch holds several groups."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    x = rng.normal(size=(6, 4)).astype(np.float32)
    rows = [(key, held, held, rep, 1, x[rep % 6]) for key in ("4/0/0/a", "4/0/0/b") for held, reps in ((True, range(6)), (False, range(6, 18))) for rep in reps]
    rows = [r for r in rows if r[1] or r[0].endswith("a")]
    table = pa.table({"key": [r[0] for r in rows], "held": [r[1] for r in rows], "asks": [r[2] for r in rows], "rep": [r[3] for r in rows],
                      "copies": [r[4] for r in rows], "vector": pa.array([r[5].tolist() for r in rows], pa.list_(pa.float32()))})
    whole = {(r["rep"], r["n"]) for b in hnsw._search(0.93)(iter(table.to_batches())) for r in b.to_pylist() if r["rep"] is not None}
    for size in (1, 4, 7):
        cut = {(r["rep"], r["n"]) for b in hnsw._search(0.93)(iter(table.to_batches(size))) for r in b.to_pylist() if r["rep"] is not None}
        assert cut == whole and {rep for rep, _ in whole} >= set(range(6, 18))
