"""Conversation repair against a plain search over all edits, in one segment and in many."""

import hashlib
import random

import pytest

from rowmill.llm import conversations as c

STEP = {0: "sua", 1: "u", 2: "a", 3: "u"}


def plain(symbols):
    """Least (cost, audit) by trying all edits from the last row to the first."""
    after = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for x in reversed(symbols):
        row = {}
        for q in range(4):
            ways = [(2 + after[q][0], "D" + after[q][1])]
            if x != "x":
                more = 5 if x.isupper() else 0
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, x.lower()))
                if to is not None:
                    ways.append((more + after[to][0], "K" + after[to][1]))
                to = 3 if q == 2 else 2
                ways.append((1 + more + after[to][0], "R" + after[to][1]))
            row[q] = min(ways)
        for _ in range(3):
            row = {q: min(row[q], (5 + row[3 if q == 2 else 2][0], "I" + row[3 if q == 2 else 2][1])) for q in range(4)}
        after = row
    return after[0]


def test_auction_equals_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        symbols = "".join(rng.choice(c.SYMBOLS) for _ in range(rng.randrange(12)))
        cost, letters, ends = c.edits(symbols, c.ending()[0])
        tail = "I" * len(c.TAILS[ends[0]])
        assert (cost[0], letters[0] + tail) == plain(symbols), symbols
    for symbols in ("u" * 500, "sUaX".replace("X", "x") * 100, "a" * 300 + "x" * 300):
        cost, letters, ends = c.edits(symbols, c.ending()[0])
        assert (cost[0], letters[0] + "I" * len(c.TAILS[ends[0]])) == plain(symbols)


def test_costs_between_states_compose():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        one, two = ("".join(rng.choice(c.SYMBOLS) for _ in range(rng.randrange(1, 7))) for _ in range(2))
        a, b, both = (np.array(c.way_costs(s)).reshape(4, 4) for s in (one, two, one + two))
        assert (c._times(a, b) == both).all()
        ends = np.array(c.ending()[0])
        assert (both + ends).min(1)[0] == plain(one + two)[0]


def _plain_rows(rows):
    """Faults, audit and messages of one conversation's rows (turn, role, text), as the docstring of repair has them."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda z: (z[0] is not None, z[0] or 0, hashlib.md5(z[1].encode()).hexdigest() + hashlib.md5(z[2].encode()).hexdigest()))
    seen, symbols, counts, codes = set(), "", [0, 0, 0], []
    for _, role, text in rows:
        code = role[:1] if role[:1] in tuple("sua") else "o"
        codes.append(code)
        cut = text.rstrip(c.BLANKS)
        fault = 0 if not cut else 1 if (role, text) in seen else 2 if cut[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        symbols += "x" if fault in (0, 1) else code.upper() if fault == 2 else code
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain(symbols)
    out, k, q = [], 0, 0
    for letter in audit:
        if letter == "I":
            q = 3 if q == 2 else 2
            out.append(({2: "user", 3: "assistant"}[q], ""))
            continue
        _, role, text = rows[k]
        k += 1
        if letter == "R":
            q = 3 if q == 2 else 2
            out.append(({2: "user", 3: "assistant"}[q], text))
        elif letter == "K":
            q = {"s": 1, "u": 2, "a": 3}[role[0]]
            out.append((role, text))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2],
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), "cost": cost, "audit": audit}, out


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "sys"]
    texts = ["Yes.", "no", "", None, " \t\n", "Why?\n", "word " * 5000 + ".", "日本。", "a!", "b."]
    rows = [(conv, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for conv in [None, *range(20)] for _ in range(rng.randrange(9))]
    rows += [(99, k, rng.choice(roles), f"{rng.choice(texts)}{rng.randrange(60)}{rng.choice(['.', ''])}") for k in range(150)] + [(50, None, "user", "same.")] * 20
    return rows


@pytest.mark.parametrize("segment, fan", [(256, 1024), (4, 3)])
def test_repair_equals_plain_version(spark, odd_rows, monkeypatch, segment, fan):
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "FAN", fan)
    df = spark.createDataFrame([(*r, 1, "x") for r in odd_rows], "conv_id long, turn long, role string, text string, seg int, key string").repartition(5)
    found, messages = c.repair(df)
    got = {r["conv"]: r.asDict() for r in found.collect()}
    told = {}
    for r in sorted(messages.collect(), key=lambda r: (r["conv"], r["seg"], r["at"])):
        told.setdefault(r["conv"], []).append((r["role"], r["text"]))
    digests = {r["conv"]: r["sha256"] for r in c.message_digests(messages).collect()}
    convs = {r[0] for r in odd_rows}
    assert len(got) == len(convs)
    for conv in convs:
        want, lines = _plain_rows([r[1:] for r in odd_rows if r[0] == conv])
        name = "-" if conv is None else f"={conv}"
        assert {k: got[name][k] for k in want} == want
        assert told.get(name, []) == lines
        if lines:
            assert digests[name] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, messages = c.repair(c.damage(df))
    assert found.count() == 0 and messages.count() == 0 and c.message_digests(messages).count() == 0
