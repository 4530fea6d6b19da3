"""Conversation structure repair: cheapest edits of roles and turns, by an auction on a lattice of rows and states."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmill.llm.staging import stage
from rowmill.session import shuffle_partitions

#: Rows of a conversation in a segment (a power of two), and segments that one task composes.
SEGMENT, FAN = 256, 1024
#: Costs of the edits, and of leaving a row that ends in mid-sentence.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system message, after one of the user, after one of the assistant. START and DONE end well.
STATES, ACCEPTING = 4, (0, 3)
#: What each state may be followed by: the state and the role an inserted or renamed message gets.
NEXT = (2, 2, 3, 2)
FAR = 1 << 40
#: Segments whose costs and edits a worker remembers.
CACHE = 1 << 14

# A row is one letter: what is left to do with it. "x" must go; s, u, a (by its role) or o (another role) may stay;
# upper-case letters are the same for rows that end in mid-sentence.
SYMBOLS = "xsuaoSUAO"


def _arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost and the state after it."""
    out = [("D", DELETE, state)]
    if symbol == "x":
        return out
    more = UNFINISHED if symbol.isupper() else 0
    to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(symbol.lower())
    if to is not None:
        out.append(("K", KEEP + more, to))
    out.append(("R", REROLE + more, NEXT[state]))
    return out


class Lattice:
    """Nodes (row, state) of a segment and a last node behind its end; arcs are edits of the row or insertions before it.

    Prices stay below the cost of the way to the last node (the price of an arc's tail never exceeds its cost and the
    price of its head); those of a row begin at the least one of the row behind it. An auction from a node keeps a path: where the price of the path's end is less than the
    least cost and price of an arc, the price rises to that and the path is contracted, else it is extended by that
    arc. Where it meets the last node or one whose price an earlier auction has settled, all prices of the path are
    exact: they are settled too. Origins go from the last row to the first, so paths stay short.
    """

    def __init__(self, symbols: str, ends: tuple[int, ...]):
        self.n = n = len(symbols)
        self.last = (n + 1) * STATES
        self.arcs: list = [None] * self.last
        self.price, self.settled = [FAR] * self.last + [0], [True] * (self.last + 1)
        for state in range(STATES):  # what lies behind the segment is one arc of known cost
            self.arcs[n * STATES + state] = [("", ends[state], self.last)]
            self.price[n * STATES + state] = min(ends[state], FAR)
        for row in range(n - 1, -1, -1):
            nodes = range(row * STATES, (row + 1) * STATES)
            for state, node in enumerate(nodes):
                arcs = [(letter, cost, (row + 1) * STATES + to) for letter, cost, to in _arcs(symbols[row], state)]
                self.arcs[node] = sorted([*arcs, ("I", INSERT, row * STATES + NEXT[state])])
            open_ = self._open(nodes)  # nodes without a way stay settled, at FAR
            least = min(self.price[(row + 1) * STATES:(row + 2) * STATES])
            for node in open_:
                self.price[node], self.settled[node] = least, False
            for node in open_:
                self.auction(node)

    def _open(self, nodes: range) -> list[int]:
        """Nodes of a row that have a way to the end."""
        found: set[int] = set()
        for _ in nodes:
            found |= {node for node in nodes if any(head in found or head >= nodes.stop and self.price[head] < FAR for _, _, head in self.arcs[node])}
        return sorted(found)

    def auction(self, origin: int) -> None:
        price, settled, arcs = self.price, self.settled, self.arcs
        path = [origin]
        while not settled[path[-1]]:
            node = path[-1]
            least, to = min((cost + price[head], head) for _, cost, head in arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            settled[node] = True

    def trace(self, state: int) -> tuple[str, int]:
        """The letters along tight arcs from the first row, the least letter at each node, and the state at the end."""
        node, letters = state, []
        while node < self.n * STATES:
            letter, node = next((letter, head) for letter, cost, head in self.arcs[node] if self.price[node] == cost + self.price[head])
            letters.append(letter)
        return "".join(letters), node - self.n * STATES


@functools.lru_cache(maxsize=CACHE)
def way_costs(symbols: str) -> tuple[int, ...]:
    """Costs from each state before a segment to each state behind it, row by row (FAR: no way)."""
    columns = []
    for end in range(STATES):
        lattice = Lattice(symbols, tuple(0 if k == end else FAR for k in range(STATES)))
        columns.append([min(lattice.price[k], FAR) for k in range(STATES)])
    return tuple(columns[end][start] for start in range(STATES) for end in range(STATES))


@functools.lru_cache(maxsize=CACHE)
def edits(symbols: str, ends: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """By the state before a segment: the least cost to the conversation's end, the letters, the state behind the segment."""
    lattice = Lattice(symbols, ends)
    traced = [lattice.trace(k) if lattice.price[k] < FAR else ("", k) for k in range(STATES)]
    return tuple(lattice.price[:STATES]), tuple(t[0] for t in traced), tuple(t[1] for t in traced)


@functools.lru_cache(maxsize=1)
def ending() -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost and letters from each state at a conversation's end: insertions until it is complete."""
    costs, letters = [], []
    for state in range(STATES):
        n = 0
        while state not in ACCEPTING:
            state, n = NEXT[state], n + 1
        costs.append(INSERT * n)
        letters.append("I" * n)
    return tuple(costs), tuple(letters)


def apply_edits(symbols: str, letters: str, state: int) -> tuple[list[str], list[str], list[str]]:
    """Per row: roles inserted before it (initials), what happens to it (K, D, or the new role's initial), letters so far used."""
    before, own, waiting = [], [], ""
    row = 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            waiting += "ua"[state - 2]
            continue
        symbol = symbols[row]
        row += 1
        if letter == "D":
            own.append("D")
        elif letter == "R":
            state = NEXT[state]
            own.append("ua"[state - 2])
        else:
            state = {"s": 1, "u": 2, "a": 3}[symbol.lower()]
            own.append("K")
        before.append(waiting)
        waiting = ""
    return before, own, [waiting]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums over the states between two stretches."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


_SAME = np.where(np.eye(STATES, dtype=bool), 0, FAR)


def _running(frame: pd.DataFrame, first: np.ndarray, reverse: bool) -> list[list[int]]:
    """What all earlier (or all later) stretches of a group make together, for each of its stretches."""
    out, total = [], first
    matrices = [np.asarray(m, np.int64).reshape(STATES, STATES) for m in frame["matrix"]]
    for m in reversed(matrices) if reverse else matrices:
        out.append(total.ravel().tolist())
        total = _times(m, total) if reverse else _times(total, m)
    return out[::-1] if reverse else out


def running_products(stretches: DataFrame, reverse: bool) -> DataFrame:
    """conv, seg and outside: the product of all matrices of the conversation before the stretch (or after it).

    At most FAN stretches meet in a task: groups of FAN make one stretch of the level above, whose own running product
    is what the group begins with. Levels go on until no conversation has more than FAN stretches, so their number
    grows with the logarithm of the longest conversation.
    """
    most = stretches.agg(F.max("seg")).first()[0]
    schema = "conv string, seg long, outside array<long>"
    if most is None or most < FAN:
        def whole(frame):
            frame = frame.sort_values("seg")
            return pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "outside": _running(frame, _SAME, reverse)})

        return stretches.groupBy("conv").applyInPandas(whole, schema)

    def product(frame):
        frame = frame.sort_values("seg")
        total = _SAME
        for m in frame["matrix"]:
            total = _times(total, np.asarray(m, np.int64).reshape(STATES, STATES))
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "seg": frame["seg"].iloc[:1] // FAN, "matrix": [total.ravel().tolist()]})

    group = [F.col("conv"), F.floor(F.col("seg") / FAN).alias("above")]
    above = stage(stretches.groupBy(*group).applyInPandas(product, "conv string, seg long, matrix array<long>"), "stretches")
    begins = running_products(above, reverse).withColumnRenamed("seg", "above")

    def inside(own, outer):
        own = own.sort_values("seg")
        first = np.asarray(outer["outside"].iloc[0], np.int64).reshape(STATES, STATES)
        return pd.DataFrame({"conv": own["conv"], "seg": own["seg"], "outside": _running(own, first, reverse)})

    return stretches.groupBy(*group).cogroup(begins.groupBy("conv", "above")).applyInPandas(inside, schema)


def _code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))


#: Blanks: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def _segments(frames):
    """Letters, counts and both ends of each segment."""
    for frame in frames:
        out = []
        for conv, seg, rows, firsts in zip(frame["conv"], frame["seg"], frame["rows"], frame["firsts"]):
            firsts = set() if firsts is None else {int(f) for f in firsts}
            symbols, codes, turns, counts = [], [], [], [0, 0, 0]
            for r in rows:
                codes.append(r["code"])
                turns.append(None if r["turn"] is None or r["turn"] != r["turn"] else int(r["turn"]))
                fault = 0 if r["blank"] else 1 if int(r["pos"]) not in firsts else 2 if r["unfinished"] else None
                if fault is not None:
                    counts[fault] += 1
                symbols.append("x" if fault in (0, 1) else r["code"].upper() if fault == 2 else r["code"])
            known = [t for t in turns if t is not None]
            odd = sum(a + b not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
            out.append((conv, seg, "".join(symbols), [r["key"] for r in rows], *counts, odd, codes[0], codes[-1], turns[0], turns[-1],
                        min(known, default=None), max(known, default=None), len(set(known))))
        frame = pd.DataFrame(out, columns=SEGMENT_COLUMNS)
        yield frame.astype({c: "Int64" for c in ("first_turn", "last_turn", "low", "high")})


SEGMENT_SCHEMA = ("conv string, seg long, symbols string, keys array<string>, blank long, duplicate long, truncated long, illegal long, "
                  "first_code string, last_code string, first_turn long, last_turn long, low long, high long, turns long")
SEGMENT_COLUMNS = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
EDIT_SCHEMA = "conv string, seg long, cost long, letters string, messages array<struct<key: string, role: string>>"


def _edited(conv, seg, symbols, keys, cost, letters, state, tail):
    """A row of edits: the messages that stay or are inserted, in order; role is null where it stays."""
    before, own, _ = apply_edits(symbols, letters, state)
    messages = []
    for roles, what, key in zip(before, own, keys):
        messages += [{"key": None, "role": ROLES[r]} for r in roles]
        if what != "D":
            messages.append({"key": key, "role": None if what == "K" else ROLES[what]})
    messages += [{"key": None, "role": ROLES[r]} for r in tail]
    return conv, seg, cost, letters + "I" * len(tail), messages


ROLES = {"u": "user", "a": "assistant"}
TAILS = ("", "ua", "a", "")  # what completes a conversation that ends in each state


def _alone(frames):
    """Edits of conversations of one segment."""
    costs = ending()[0]
    for frame in frames:
        out = []
        for conv, seg, symbols, keys in zip(frame["conv"], frame["seg"], frame["symbols"], frame["keys"]):
            cost, letters, ends = edits(symbols, costs)
            out.append(_edited(conv, seg, symbols, keys, cost[0], letters[0], 0, TAILS[ends[0]]))
        yield pd.DataFrame(out, columns=["conv", "seg", "cost", "letters", "messages"])


def _long(parts: DataFrame) -> DataFrame:
    """Edits of conversations of several segments: costs behind each segment, edits from each state, the state before it."""
    def matrices(frames):
        for frame in frames:
            yield pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "matrix": [list(way_costs(s)) for s in frame["symbols"]]})

    def behind(outside):
        after = np.asarray(outside, np.int64).reshape(STATES, STATES) + np.asarray(ending()[0])[None, :]
        return tuple(int(x) for x in after.min(1))

    def steps(frames):
        for frame in frames:
            rows = []
            for symbols, outside in zip(frame["symbols"], frame["outside"]):
                _, _, ends = edits(symbols, behind(outside))
                rows.append([0 if ends[i] == j else FAR for i in range(STATES) for j in range(STATES)])
            yield pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "matrix": rows})

    def choose(frames):
        for frame in frames:
            out = []
            for conv, seg, symbols, keys, after, prior, final in zip(*(frame[c] for c in (
                    "conv", "seg", "symbols", "keys", "outside", "prior", "final"))):
                state = int(np.argmin(np.asarray(prior, np.int64).reshape(STATES, STATES)[0]))
                cost, letters, ends = edits(symbols, behind(after))
                out.append(_edited(conv, seg, symbols, keys, cost[state], letters[state], state, TAILS[ends[state]] if final else ""))
            yield pd.DataFrame(out, columns=["conv", "seg", "cost", "letters", "messages"])

    parts = stage(parts, "parts")
    light = parts.select("conv", "seg", "symbols")
    costs = stage(light.mapInPandas(matrices, "conv string, seg long, matrix array<long>"), "ways")
    after = stage(running_products(costs, reverse=True), "behind")
    taken = stage(light.join(after, ["conv", "seg"]).mapInPandas(steps, "conv string, seg long, matrix array<long>"), "steps")
    prior = running_products(taken, reverse=False).withColumnRenamed("outside", "prior")
    return parts.join(after, ["conv", "seg"]).join(prior, ["conv", "seg"]).mapInPandas(choose, EDIT_SCHEMA)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: faults and cheapest edits per conversation, and the messages of the repaired conversations.

    The first has conv (a key of text, see ``conv_key``), gaps, blank, duplicate, truncated, illegal, cost and audit (the initials of the edits:
    Keep 0, Rerole 1, Delete 2, Insert 5, and 5 for a row that stays though it ends in mid-sentence); of all cheapest
    edits whose role initials read ``(s?(ua)+)?`` the audit is the ASCII-least. The second has conv, seg and at (both
    give the order), role and text.

    Rows are range-partitioned by conversation, turn (nulls first) and a hash of role and text, so the order of equal
    turns is defined; without texts. Consecutive rows of a conversation form segments of at most SEGMENT rows. Each
    segment's least costs between the states before and behind it, which four auctions find, are multiplied over
    the later segments (least sums, FAN segments a task and level); the auction with these costs behind the segment
    gives exact prices, whose tight arcs are traced for each state before it; the states are multiplied over the
    earlier segments. So a conversation of any length is repaired in bounded tasks, with one small row per segment where segments are numbered.

    A null role or text is one space. Rows whose role has another initial than s, u or a (or none) cannot be kept as they are. Equal
    rows are duplicates, of which the first stays at most. A null conversation is one of its own; null turns come
    first and count for no gap. An empty table gives empty tables. Other columns have no effect.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = df.select(conv_key(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("key", F.concat(F.md5("role"), F.md5("text")))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv", "turn", "key", _code(F.col("role")).alias("code"), (F.length(trimmed) == 0).alias("blank"),
                        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("unfinished"), F.monotonically_increasing_id().alias("spread"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("key"), F.col("spread")]
    laid = stage(light.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).drop("spread").withColumn(
        "pos", F.monotonically_increasing_id()), "laid")
    seg = F.floor(F.col("pos") / SEGMENT).alias("seg")
    firsts = laid.groupBy("conv", "key").agg(F.min("pos").alias("pos")).groupBy("conv", seg).agg(F.collect_list("pos").alias("firsts"))
    cut = laid.groupBy("conv", seg).agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "key", "code", "blank", "unfinished"))).alias("rows"))
    segments = stage(cut.join(firsts, ["conv", "seg"], "left").mapInPandas(_segments, SEGMENT_SCHEMA), "segments")

    w = "OVER (PARTITION BY conv ORDER BY seg)"
    heads = segments.select("conv", "seg", "first_code", "last_code", "first_turn", "last_turn").selectExpr(
        "conv", "seg", f"row_number() {w} - 1L AS number", f"lead(seg) {w} IS NULL AS final",
        f"coalesce(lag(last_code) {w} || first_code NOT IN ('su', 'ua', 'au'), false) AS odd", f"coalesce(lag(last_turn) {w} = first_turn, false) AS again")
    heads = stage(heads, "heads")
    alone = F.col("number").eqNullSafe(F.lit(0)) & F.col("final")
    joined = segments.join(heads, ["conv", "seg"])
    edited = joined.where(alone).select("conv", F.lit(0).cast("long").alias("seg"), "symbols", "keys").mapInPandas(_alone, EDIT_SCHEMA)
    if not heads.where(~alone).isEmpty():
        edited = edited.unionByName(_long(joined.where(~alone).select("conv", F.col("number").alias("seg"), "symbols", "keys", "final")))
    edited = stage(edited, "edited")

    faults = joined.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum(F.col("odd").cast("long"))).alias("illegal"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum(F.col("again").cast("long")), F.lit(0)).alias("gaps"))
    audits = edited.groupBy("conv").agg(
        F.sum(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    messages = edited.select("conv", "seg", F.posexplode("messages").alias("at", "m")).select(
        "conv", "seg", "at", F.col("m.key").alias("key"), F.col("m.role").alias("to"))
    own = rows.select("conv", "key", "role", "text").dropDuplicates(["conv", "key"])
    stay = messages.where("key is not null").join(own, ["conv", "key"]).select("conv", "seg", "at", F.coalesce("to", "role").alias("role"), "text")
    new = messages.where("key is null").select("conv", "seg", "at", F.col("to").alias("role"), F.lit("").alias("text"))
    return faults.join(audits, "conv"), stay.unionByName(new)


def conv_key(conv: Column) -> Column:
    """The key of a conversation, by which the tables of ``repair`` name it: a null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("-"))


def message_digests(messages: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its messages in order, as ``role:text`` joined by line breaks.

    A digest is sequential, so the messages of a conversation pass through one task, sorted on disk, one batch at a
    time; only the state of the hash is kept.
    """
    def run(batches):
        conv, state = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != conv:
                    if conv is not None:
                        done[0].append(conv)
                        done[1].append(state.hexdigest())
                    conv, state = name, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=["conv", "sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "sha256"])

    lines = messages.repartition("conv").sortWithinPartitions("conv", "seg", "at").select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(run, "conv string, sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops a row, 1 empties
    its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes its role user."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = df.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", times.alias("copy")).drop("copy")
