"""Near-duplicate vectors: a navigable small-world graph per shard, searched by every vector of the same label."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from rowmill.llm.components import components
from rowmill.llm.staging import stage

#: Floats of a shard's vectors, and the fewest components that a vector counts for (so a shard holds at most 32768 vectors).
SHARD_FLOATS, LEAST_SIZE = 1 << 21, 64
#: Vectors of a block of queries, in shards: a task builds the graph of its shard and then lets a block pass, so that building
#: is the smaller part of its work.
BLOCK_SHARDS = 8
#: Neighbours of a node on the upper levels (twice as many on the lowest), beam of the construction, first beam of a query.
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 64, 64
#: One node of so many (64 at least) is audited: its links to others are also found by comparing all, and the graph must find this share.
AUDIT_EVERY, AUDIT_ROWS, AUDIT_RECALL = 64, 64, 1.0
#: Floats gathered in one step of a search, marks of visited nodes, and similarities held at a time where all are compared.
STEP_FLOATS, SEEN_MARKS, PRODUCT_FLOATS = 1 << 21, 1 << 24, 1 << 23
#: Pairs of query and node that a search holds at a time, and of those, how many are compared in double precision.
HELD_PAIRS, EXACT_PAIRS = 1 << 18, 1 << 14

#: Partitions for each pair of shard and block (so that few meet in one), and the most pairs that count.
SPREAD, MOST_TASKS = 2, 20_000


class Graph:
    """Levels of neighbour lists over unit vectors; the lowest holds all nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        draw = -np.log(1 - rng.random(n)) / np.log(NEIGHBOURS)
        self.level = np.minimum(draw.astype(np.int64), 8)
        self.top = int(self.level.max()) if n else 0
        self.links = [np.full((n, NEIGHBOURS * (1 if k else 2)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = -1
        self._build()

    def _build(self):
        n = len(self.vectors)
        order = np.argsort(-self.level, kind="stable")  # the upper levels first: they guide all later searches
        done = 0
        while done < n:
            batch = order[done:done + max(1, min(256, done))]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch):
        if self.entry < 0:
            self.entry = int(batch[0])
            return
        x = self.vectors[batch]
        peers = x @ x.T
        start = np.full(len(batch), self.entry)
        for k in range(self.top, -1, -1):
            here = np.flatnonzero(self.level[batch] >= k)
            beam = BUILD_BEAM if len(here) else 1
            ids, sims = self.search_level(x, start, beam, k)
            start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
            for i in here:
                found = ids[i][ids[i] >= 0]
                near = here[here < i]
                candidates = np.concatenate([found, batch[near]])
                value = np.concatenate([sims[i][:len(found)], peers[i, near]])
                node = int(batch[i])
                chosen = self._choose(candidates, value, NEIGHBOURS)
                self.links[k][node, :len(chosen)] = chosen
                for other in chosen.tolist():
                    self._add(k, other, node)

    def _choose(self, candidates, value, most):
        """The nearest candidates of which none is nearer to one chosen before than to the node; then the nearest others."""
        order = np.argsort(-value, kind="stable")[:BUILD_BEAM]
        candidates, value = candidates[order], value[order]
        if len(candidates) <= most // 2:
            return candidates
        among = self.vectors[candidates] @ self.vectors[candidates].T
        taken, rest = [], []
        best = np.full(len(candidates), -np.inf)
        for i in range(len(candidates)):
            if len(taken) == most:
                break
            if best[i] < value[i]:
                taken.append(i)
                np.maximum(best, among[i], out=best)
            else:
                rest.append(i)
        taken += rest[:max(0, most // 2 - len(taken))]
        return candidates[taken]

    def _add(self, k, node, other):
        row = self.links[k][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        candidates = np.append(row, other)
        chosen = self._choose(candidates, self.vectors[candidates] @ self.vectors[node], len(row))
        row[:] = -1
        row[:len(chosen)] = chosen

    def search_level(self, queries, start, beam, k):
        """Beams of many queries in step: ids (-1: none) and similarities, the nearest first."""
        out_ids = np.full((len(queries), beam), -1, np.int64)
        out_sims = np.full((len(queries), beam), -np.inf, np.float32)
        width = self.links[k].shape[1]
        expand = max(2, beam // 32)
        block = max(1, min(512, STEP_FLOATS // (expand * width * self.vectors.shape[1]), SEEN_MARKS // len(self.vectors)))
        for low in range(0, len(queries), block):
            q = queries[low:low + block]
            ids, sims = self._beam(q, start[low:low + block], beam, k, expand)
            out_ids[low:low + block], out_sims[low:low + block] = ids, sims
        return out_ids, out_sims

    def _beam(self, q, start, beam, k, expand):
        n, m = len(self.vectors), len(q)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        fresh = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)
        ids[:, 0], fresh[:, 0] = start, True
        sims[:, 0] = np.einsum("ij,ij->i", q, self.vectors[start])
        seen[rows, start] = True
        active = rows
        while len(active):
            value = np.where(fresh[active], sims[active], -np.inf)
            some = np.argpartition(-value, min(expand, beam) - 1, axis=1)[:, :expand]
            ok = np.take_along_axis(value, some, 1) > -np.inf
            live = ok.any(1)
            active, some, ok = active[live], some[live], ok[live]
            if not len(active):
                break
            node = np.where(ok, np.take_along_axis(ids[active], some, 1), -1)
            mark = fresh[active]
            np.put_along_axis(mark, some, False, 1)
            fresh[active] = mark
            near = np.where(node[:, :, None] >= 0, self.links[k][node], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)  # a node that two expansions reach counts once
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[active[:, None], near] & (near >= 0)] = -1
            i, j = np.nonzero(near >= 0)
            seen[active[i], near[i, j]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[i, j] = np.einsum("ij,ij->i", q[active[i]], self.vectors[near[i, j]])
            all_sims = np.hstack([sims[active], found])
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.take_along_axis(np.hstack([ids[active], near]), keep, 1)
            fresh[active] = np.take_along_axis(np.hstack([fresh[active], near >= 0]), keep, 1)
        ids[sims == -np.inf] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries, beam):
        start = np.full(len(queries), self.entry)
        for k in range(self.top, 0, -1):
            ids, _ = self.search_level(queries, start, 4, k)
            start = ids[:, 0]
        return self.search_level(queries, start, beam, 0)

    def pairs(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of similarity ``least`` or more, ``HELD_PAIRS`` at a time (and as many as a query has).

        A query whose beam holds nothing else may have more links than the beam, and one that does not find its own node
        (``own``, -1: it has none here) stands where no neighbour list leads; both are compared with all nodes instead.
        """
        beam = min(beam, len(self.vectors))
        step = max(1, HELD_PAIRS // max(1, beam))
        for low in range(0, len(queries), step):
            some = queries[low:low + step]
            ids, sims = self.search(some, beam)
            near = sims >= least
            whole = near.all(1)
            if own is not None:
                place = own[low:low + step]
                whole |= (place >= 0) & ~(ids == place[:, None]).any(1)
            i, j = np.nonzero(near & ~whole[:, None])
            yield low + i, ids[i, j]
            left = np.flatnonzero(whole)
            for k, node in self.all_pairs(some[left], least):
                yield low + left[k], node

    def all_pairs(self, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same pairs by products of blocks of queries with all vectors."""
        step = max(1, PRODUCT_FLOATS // max(1, len(self.vectors)))
        for low in range(0, len(queries), step):
            near = queries[low:low + step] @ self.vectors.T >= least
            ends, start = np.cumsum(np.count_nonzero(near, axis=1)), 0
            while start < len(near):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + HELD_PAIRS, "right")))
                i, j = np.nonzero(near[start:stop])
                yield low + start + i, j
                start = stop

    def within(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None):
        """All pairs at once."""
        return _joined(self.pairs(queries, least, beam, own))

    def all_within(self, queries: np.ndarray, least: float):
        return _joined(self.all_pairs(queries, least))

    def audited_beam(self, least: float) -> int:
        """The first beam, doubled until the audited nodes find their links to others; at the size of the shard all are compared."""
        n = len(self.vectors)
        some = np.unique(np.linspace(0, n - 1, min(n, max(AUDIT_ROWS, n // AUDIT_EVERY))).astype(np.int64))
        others = lambda found: sum(int((some[i] != j).sum()) for i, j in found)
        truth = others(self.all_pairs(self.vectors[some], least))
        beam = BEAM
        while beam < n and others(self.pairs(self.vectors[some], least, beam, some)) < AUDIT_RECALL * truth:
            beam *= 2
        return beam


def _joined(found) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *found]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths in double precision, some rows at a time."""
    out = np.empty(len(rows))
    for low in range(0, len(rows), EXACT_PAIRS):
        x = rows[low:low + EXACT_PAIRS].astype(np.float64)
        out[low:low + EXACT_PAIRS] = np.sqrt((x * x).sum(1))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm, out = _norms(rows), np.empty(rows.shape, np.float32)
    for low in range(0, len(rows), EXACT_PAIRS):
        out[low:low + EXACT_PAIRS] = rows[low:low + EXACT_PAIRS].astype(np.float64) / norm[low:low + EXACT_PAIRS, None]
    return out


def _merge(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of a forest (each node's smallest known relative) after joining the trees of the pairs (a, b)."""
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(up, high, low)
        while True:
            above = up[up]
            if (above == up).all():
                break
            up = above
        a, b = low, high
    return up


class Shard:
    """Nodes of a shard with their graph, and the forest of the links that its queries have found among them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, rows: np.ndarray, least: float):
        self.ids, self.copies, self.rows, self.least = ids, copies, rows, least
        self.norm, self.up = _norms(rows), np.arange(len(ids))
        self.graph = Graph(_unit(rows))
        self.beam = self.graph.audited_beam(least)

    def ask(self, reps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows linked with each query, and one node that it is linked with (-1: none); the others join that node's tree."""
        counts, first = np.zeros(len(reps), np.int64), np.full(len(reps), -1)
        place = np.minimum(np.searchsorted(self.ids, reps), len(self.ids) - 1)
        place[self.ids[place] != reps] = -1
        norm = _norms(rows)
        for q, node in self.graph.pairs(_unit(rows), self.least - 1e-5, self.beam, place):
            for low in range(0, len(q), EXACT_PAIRS):  # the cosine in double precision decides
                i, j = q[low:low + EXACT_PAIRS], node[low:low + EXACT_PAIRS]
                dot = np.einsum("ij,ij->i", rows[i].astype(np.float64), self.rows[j].astype(np.float64))
                ok = (dot / (norm[i] * self.norm[j]) >= self.least) & (reps[i] != self.ids[j])
                i, j = i[ok], j[ok]
                np.add.at(counts, i, self.copies[j])
                new = first[i] < 0
                first[i[new]] = j[new]
                self.up = _merge(self.up, first[i], j)
        return counts, first


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Node, copies, whether it asks, and vectors as a matrix."""
    rep, copies, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "asks"))
    return rep, copies, asks, batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
    """Pieces of batches of one key that are held by its shard, or are not."""
    for batch in batches:
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for c in (batch.column("key"), batch.column("held")):
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(new).tolist(), n]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.column("key")[low].as_py(), batch.column("held")[low].as_py(), batch.slice(low, high - low)


def _search(least: float):
    """Counts of queries and edges of a spanning forest, from rows that come by key, the shard's own nodes before the others."""
    whole = pa.schema([(c, pa.int64()) for c in ("rep", "n", "a", "b")])

    def of_group(group: Iterator[tuple[str, bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        own, other = [], []
        for _, held, batch in group:
            if not held:
                other = [batch]
                break
            own.append(_arrays(batch))
        if not own:
            return
        ids, copies, asks, rows = (np.concatenate(x) for x in zip(*own))
        del own
        shard = Shard(ids, copies, rows, least)
        some = np.flatnonzero(asks)
        blocks = ((ids[k], rows[k]) for k in (some[low:low + EXACT_PAIRS] for low in range(0, len(some), EXACT_PAIRS)))
        others = ((x[0], x[3]) for x in map(_arrays, chain(other, (batch for *_, batch in group))))
        for reps, vectors in chain(blocks, others):
            counts, first = shard.ask(reps, vectors)
            k = np.flatnonzero(first >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (reps[k], counts[k], reps[k], ids[first[k]])], schema=whole)
        k = np.flatnonzero(shard.up != np.arange(len(ids)))
        none = pa.nulls(len(k), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[k]), pa.array(ids[shard.up[k]])], schema=whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_runs(batches), key=lambda piece: piece[0]):
            yield from of_group(group)

    return run


def near_vectors(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Columns id, n_links, component_id, kept of every row: links are cosines of ``least`` or more within a label.

    Equal vectors of a label are one node with a number of copies. Nodes of a label (and number of components) are dealt to
    shards by a hash, each shard gets a graph, and every node queries every shard of its label in blocks. A task gets the nodes
    of a shard, builds their graph, and lets the queries of a block pass in batches: the graph never leaves its worker, and
    what a worker holds is bounded by the shard, however many nodes or links a label has. Beams are widened per shard until an
    audit of a share of its nodes against all vectors of the shard finds every link. A query whose beam is full of links, or
    that does not find itself, is compared with the whole shard by a matrix product, so the number of links has no cap. Cosines
    are verified in double precision. A task returns counts and a spanning forest of its links, never the pairs of a group.

    A null label or id, and a vector that is null, empty, zero or holds a null, NaN or infinity, links with nothing
    (a null id has a null component and is kept). Very large and very small components are scaled by a power of two first. Rows
    that repeat an id are vectors of their own, also in other labels: each has its own links and component, and component_id is
    the smallest id of the vectors in it. Empty tables give empty results. Other columns have no effect.
    """
    given = df.select(vector_col).schema[0].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)  # kept as it is: half the bytes
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"),
                     F.col(label_col).cast("string").alias("label"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.withColumn("most", F.when(fine, F.array_max(F.transform("vector", F.abs))))
    rows = rows.withColumn("ok", F.coalesce((F.col("most") > 0) & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    if not single:  # floats are within these bounds
        scale = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("most")), F.lit(-1022)))
        rows = rows.withColumn("vector", F.when(F.col("ok") & ~F.col("most").between(1e-100, 1e100), F.transform(
            "vector", lambda x: x / scale)).otherwise(F.col("vector")))
    exact = F.col("vector").cast("array<double>")
    rows = rows.drop("most").withColumns({"h1": F.xxhash64(exact), "h2": F.xxhash64(F.lit(1), exact)})
    nodes = rows.where("ok").groupBy("label", "h1", "h2").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("rep"), "*", F.size("vector").alias("size")), "nodes")
    sizes = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("nodes"))
    shards = F.ceil(F.col("nodes") * F.greatest("size", F.lit(LEAST_SIZE)) / SHARD_FLOATS).cast("int")
    sizes = stage(sizes.select("label", "size", shards.alias("shards"), F.ceil(shards / BLOCK_SHARDS).cast("int").alias("blocks")), "sizes")
    pairs_n = min(max(1, sizes.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 0), MOST_TASKS)
    dealt = nodes.join(sizes, ["label", "size"]).withColumns({
        "shard": F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"),
        "block": F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")})
    place = lambda shard, block, held, asks: F.struct(shard.alias("to"), block.alias("of"), held.alias("held"), asks.alias("asks"))
    asked = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: place(s, F.col("block"), s == F.col("shard"), F.lit(True)))
    held = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")),
                       lambda b: place(F.col("shard"), b, F.lit(True), F.lit(False)))
    met = dealt.select("label", "size", "rep", "copies", "vector", F.explode(F.concat(asked, held)).alias("at")).select(
        F.concat_ws("/", "size", "at.to", "at.of", "label").alias("key"), "at.held", "at.asks", "rep", "copies", "vector")
    met = met.repartition(pairs_n * SPREAD, "key").sortWithinPartitions("key", F.desc("held"), "rep")
    found = stage(met.mapInArrow(_search(least), "rep long, n long, a long, b long"), "found")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = stage(components(found.where("a is not null")), "components").withColumnRenamed("node", "rep")
    smallest = joined.join(nodes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("c_least"))
    joined = joined.join(smallest, "component").select("rep", "c_least")
    named = nodes.select("label", "h1", "h2", "rep", "copies", "least").join(counts, "rep", "left").join(joined, "rep", "left").select(
        "label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c_least", "least").alias("component"))
    known = rows.where("ok").select("id", "label", "h1", "h2").join(named, ["label", "h1", "h2"])
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.select("id", "n_links", F.col("component").alias("component_id")).union(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
