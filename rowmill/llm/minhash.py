"""Near-duplicate documents by min-max hashing: bands of minima and maxima find candidates, full sets decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowmill.llm.components import components
from rowmill.llm.staging import lists, map_text, stage
from rowmill.llm.words import lowered, mix, slice_hashes, word_bounds
from rowmill.session import shuffle_partitions

SHINGLE = 5
#: A band is two permutations, each with its minimum and its maximum. At a similarity of 0.8 the chance that no
#: band of a pair agrees is (1 - 0.8^4)^24, about 3 in a million; at 0.85 it is 2 in a hundred million.
BANDS = 24
#: A block holds so many documents and shingles at most (one more document where it crosses the bound).
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 18
COLUMNS = 2048

_WEIGHT = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the size of each set."""
    starts, ends, first = word_bounds(values, offsets)
    words = slice_hashes(lowered(values), starts, ends)
    counts = np.diff(first)
    mixed = [words * w for w in _WEIGHT]
    total = np.zeros(len(words), np.uint64)
    for k, m in enumerate(mixed):
        total[:len(words) - k] += m[k:]
    total = mix(total)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        lo, n = first[i], counts[i]
        if n < SHINGLE:
            whole = sum(int(mixed[k][lo + k]) for k in range(n)) + int(n) * _BASE_SHORT
            found = mix(np.array([whole % 2**64], np.uint64))
        else:
            found = np.unique(total[lo:lo + n - SHINGLE + 1])
        sets.append(found)
        sizes[i] = len(found)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


_BASE_SHORT = 0xC2B2AE3D27D4EB4F


def min_max(hashes: np.ndarray, begins: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of each run of hashes under each permutation: one evaluation gives two values."""
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((2 * permutations, len(begins)), np.uint64)
    for p in range(permutations):
        x = (hashes ^ seeds[2 * p]) * (seeds[2 * p + 1] | np.uint64(1))
        x ^= x >> np.uint64(29)
        out[2 * p] = np.minimum.reduceat(x, begins)
        out[2 * p + 1] = np.maximum.reduceat(x, begins)
    return out


def _signatures(bands: int):
    def run(values, offsets, _):
        hashes, sizes = shingle_hashes(values, offsets)
        n, full = len(sizes), np.flatnonzero(sizes)
        digest = np.zeros((2, n), np.uint64)
        keys = np.zeros(0, np.uint64)
        if len(full):
            begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            digest[0, full] = np.add.reduceat(mix(hashes), begins)
            digest[1, full] = np.add.reduceat(mix(hashes + np.uint64(0x5851F42D4C957F2D)), begins)
            values4 = min_max(hashes, begins, 2 * bands).reshape(bands, 4, len(full))
            keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None], (bands, len(full)))
            for k in range(4):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values4[:, k])
            keys = keys.T.ravel()
        return [pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                lists(keys.view(np.int64), np.where(sizes > 0, bands, 0), pa.int64())]

    return run


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """id, of (a hash of the text), n_shingles, digest_a and digest_b of the whole set, and one 64-bit key per band
    (none for an empty set)."""
    return map_text(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text")), "text",
                    "n_shingles long, digest_a long, digest_b long, keys array<long>", _signatures(bands)).drop("text")


def _set_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and shingles of the documents that ``wanted`` names by id and of, once where rows repeat both."""
    named = docs.withColumn("of", F.xxhash64("text")).join(wanted, ["id", "of"])
    sets = stage(shingle_sets(named, "rep", "text").withColumnRenamed("id", "rep"), "sets")
    twice = sets.groupBy("rep").count().where("count > 1").select("rep")
    if twice.isEmpty():
        return sets
    once = sets.join(twice, "rep", "left_semi").dropDuplicates(["rep"])
    return stage(sets.join(twice, "rep", "left_anti").union(once), "sets")


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the sorted distinct shingle hashes of the whole text."""
    def run(values, offsets, _):
        hashes, sizes = shingle_hashes(values, offsets)
        return [lists(hashes.view(np.int64), sizes, pa.int64())]

    return map_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text",
                    "shingles array<long>", run).drop("text")


def _blocks(members: DataFrame) -> DataFrame:
    """Give each member a block; near ones by bucket, component and size get the same.

    A member weighs its share of a block, by documents or by shingles; the weights before it in the order, rounded
    down, are its block. Partitions are summed to one number each, which the driver adds up.
    """
    def run(frames):
        part, before = TaskContext.get().partitionId(), 0.0
        for frame in frames:
            weight = np.maximum(1 / BLOCK_DOCS, frame["n_shingles"].to_numpy() / BLOCK_SHINGLES)
            ends = before + np.cumsum(weight)
            yield pd.DataFrame({"rep": frame["rep"], "part": part, "begin": ends - weight, "ending": ends})
            before = float(ends[-1]) if len(ends) else before

    spark = members.sparkSession
    order = [c for c in ("order", "component", "n_shingles", "rep") if c in members.columns]
    laid = members.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    laid = stage(laid.mapInPandas(run, "rep long, part int, begin double, ending double"), "blocks")
    starts, total = [], 0.0
    for part, weight in sorted(tuple(r) for r in laid.groupBy("part").agg(F.max("ending")).collect()):
        starts.append((part, total))
        total += weight
    starts = F.broadcast(spark.createDataFrame(starts, "part int, start double"))  # one row per partition
    return laid.join(starts, "part").select("rep", F.floor(F.col("start") + F.col("begin")).alias("block"))


def _shared(one: list, other: list) -> np.ndarray:
    """Sizes of all intersections between two lists of sets: a product of 0/1 matrices, some shingles at a time."""
    both = one + other
    _, place, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    live = seen > 1  # a shingle of one document is in no intersection of two
    number = np.cumsum(live) - 1
    keep = live[place]
    row, column = row[keep], number[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, int(live.sum()), COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        table = np.zeros((len(both), COLUMNS), np.float32)
        table[row[i:j], column[i:j] - low] = 1
        out += table[:len(one)] @ table[len(one):].T
    return out.astype(np.int64)


def _verify(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        low = frame["lo"].iloc[0]
        one = frame[frame["block"] == low]
        other = frame[frame["block"] != low]
        a_ids, a_sets = one["rep"].to_numpy(), list(one["shingles"])
        same = not len(other)
        b_ids, b_sets = (a_ids, a_sets) if same else (other["rep"].to_numpy(), list(other["shingles"]))
        if not len(a_sets):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        common = _shared(a_sets, b_sets)
        sizes = np.array([len(s) for s in a_sets])[:, None] + np.array([len(s) for s in b_sets])[None, :] - common
        i, j = np.nonzero(100 * common >= percent * sizes)
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for x, y in zip(a_ids[i].tolist(), b_ids[j].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        return pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([root(x) for x in nodes], np.int64)})

    return run


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the links between the documents listed for each pair of blocks, confirmed on full sets.

    ``rows`` has lo, hi, block, rep: only documents that share a bucket with a document of the other block and may
    be similar by the sizes of their sets are listed.
    """
    return rows.distinct().join(sets, "rep").select("lo", "hi", "block", "rep", "shingles").groupBy("lo", "hi").applyInPandas(
        _verify(percent), "a long, b long")


def _sides(block: str, other: str) -> list:
    return [F.least(block, other).alias("lo"), F.greatest(block, other).alias("hi")]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    bands: int = BANDS) -> DataFrame:
    """Columns id, of, n_shingles, component_id, component_of, kept of every row (of is xxhash64 of the text): components of links with similarity >= percent / 100.

    A document's set holds the distinct shingles of five words (A-Z lower-cased; words are what blank and tab to
    carriage return divide). Documents with equal sets are one class, numbered in the order of its smallest id and
    text hash; no two classes share a number, and a class's set is that of its smallest document. Classes that agree
    in a band form a bucket. Members of buckets are laid out in blocks of bounded size, and blocks are compared by a
    matrix product over their full sets: first each block with the blocks of its buckets' smallest members, which
    joins a large group of copies in linear work; then, for buckets that still hold more than one component, every
    two blocks that share such a bucket, except where all are one component already. Documents whose set sizes rule
    a link out are left out of a comparison. Only a spanning forest of confirmed links is written, never the pairs
    of a group, and no bucket or group has a cap.

    An empty or null text, or one without words, has no shingles and links with nothing; fewer than five words are
    one shingle. Rows with a null id have a null component and are kept. Rows that repeat an id are documents of
    their own: component_id and component_of name the smallest document of a component, by id and then by of, and
    one row of that document is kept, also where rows repeat both. Empty tables give empty results.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = stage(signatures(docs, "id", "text", bands).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = sig.where("n_shingles > 0 and id is not null").groupBy("digest_a", "digest_b").agg(
        F.min(F.struct("id", "of", "row")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    order = ["least", "digest_a", "digest_b"]
    classes = stage(classes.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("rep"), "least.*", "digest_a", "digest_b", "n_shingles", "keys"), "classes")
    keys = classes.select("rep", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = stage(keys.join(shared.select("key", "pivot"), "key"), "members")
    found = stage(members.groupBy("rep").agg(F.min("pivot").alias("order")).join(
        classes.select("rep", "n_shingles"), "rep"), "found")
    sets = _set_of_each(docs, classes.select("rep", "id", "of").join(found.select("rep"), "rep"))

    blocks = found.select("rep", "n_shingles").join(_blocks(found), "rep")
    pivots = blocks.select(*[F.col(c).alias(f"p_{c}") for c in blocks.columns])
    stars = members.where("rep <> pivot").select("rep", "pivot").distinct().join(blocks, "rep").join(
        pivots, F.col("pivot") == F.col("p_rep")).where(
        f"100 * n_shingles >= {percent} * p_n_shingles and 100 * p_n_shingles >= {percent} * n_shingles")
    stars = stage(stars.select(*_sides("block", "p_block"), "rep", "block", "p_rep", "p_block"), "stars")
    rows = stars.select("lo", "hi", "block", "rep").union(stars.select("lo", "hi", "p_block", "p_rep"))
    links = stage(_links(rows, sets, percent), "links")
    joined = components(links).withColumnRenamed("node", "rep")

    named = members.select("key", "rep").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ = stage(named.join(mixed.select("key"), "key", "left_semi").join(found, "rep"), "open")
    again = _blocks(open_.select("order", "component", "n_shingles", "rep").distinct())
    placed = open_.join(again, "rep").select("key", "rep", "component", "n_shingles", "block")
    others = placed.groupBy("key", F.col("block").alias("other")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    rows = placed.join(others, "key").where(
        f"(component <> low or component <> high) and 100 * n_shingles >= {percent} * least and 100 * most >= {percent} * n_shingles")
    more = _links(rows.select(*_sides("block", "other"), "block", "rep"), sets, percent)

    final = components(links.union(more)).withColumnsRenamed({"node": "rep"})
    smallest = classes.select(F.col("rep").alias("component"), *[F.col(c).alias(f"c_{c}") for c in ("id", "of", "row")])
    final = final.join(smallest, "component").drop("component")
    named = classes.select("digest_a", "digest_b", "rep", "id", "of", "row").join(final, "rep", "left").select(
        "digest_a", "digest_b", *[F.coalesce(f"c_{c}", c).alias(f"c_{c}") for c in ("id", "of", "row")])
    out = sig.join(named, ["digest_a", "digest_b"], "left")

    def of_component(name: str):
        return F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col(name)).otherwise(F.col(f"c_{name}"))

    return out.select("id", "of", "n_shingles", of_component("id").alias("component_id"), of_component("of").alias("component_of"),
                      F.coalesce(of_component("row") == F.col("row"), F.lit(True)).alias("kept"))
