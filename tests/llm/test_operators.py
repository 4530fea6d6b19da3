"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from rowmill.llm import bpe, hnsw, langid, lines, merkle, minhash, mixing, pretokens, quality, tokenfiles, toxicity
from rowmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, ids string, _text int, starts int"
LONG = "word " * 30_000 + "x" * 5_000
TEXTS = [(1, "The cat's  sat\n\non a mat. It rained for 3 days!"), (2, None), (3, ""), (4, " \t\n\r "), (5, LONG), (5, LONG), (5, "another text of the same id"),
         (6, "été über 日本語 \U0001F600 'll we'll"), (None, "a row without an id"), (7, "The cat's  sat\n\non a mat. It rained for 3 days!"),
         (8, "one two three"), (9, "ONE two THREE"), (10, "a shared line of more than twenty characters\nown 1"),
         (11, "  A shared line of more than twenty characters\t\nown 2\na shared line of more than twenty characters"),
         (12, "a shared line of more than twenty characters")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", None if i == 6 else f"s{(i or 0) % 2}", len(t or ""), 0.5, "x", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(load):
    return load("documents"), load("labels")


def test_bpe_equals_tiktoken_and_decodes(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    coded = bpe.encode(docs, path)
    assert set(coded.columns) == set(docs.columns)  # ids and starts are replaced, all else stays
    rows = bpe.decode(coded, path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["ids"] == library.encode_ordinary(text.decode())
        assert bytes(r["decoded"]) == text
        assert r["starts"] == sorted(r["starts"]) and all(0 <= s < len(text) for s in r["starts"])
    assert bpe.decode(bpe.encode(none, path), path).count() == 0
    whole = bpe.encode(docs, path, starts=None, decoded="lang", checked="ok", keep_text=False)
    assert "text" not in whole.columns and whole.where("not ok").count() == 0
    assert sorted(bytes(r["lang"]) for r in whole.collect()) == sorted((t or "").encode() for _, t in TEXTS)
    with pytest.raises(Exception, match="without a token"):
        bpe.decode(docs.selectExpr("array(1, 999999) ids"), path).collect()


def test_memory_of_merges_is_bounded():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.Merged(ranks, limit=3000)
    for k in range(200):
        piece = f" word{k}".encode()
        assert np.frombuffer(found[piece], np.int32).tolist() == list(bpe.merge(piece, ranks)) and found.held <= 3000


def test_long_pieces_merge_like_short_ones():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for piece in (b"the" * 30, bytes(range(97, 123)) * 3, b"\xc3\xa9" * 40, b"aaaaabbbbb" * 9):
        assert bpe._merge_long(piece, ranks) == bpe._merge_short(piece, ranks)


def _odd_pieces():
    words = [f" {a}{b}" for a in ("unhappi", "zq", "é日本", "aaaa", "ĀĀ", "0x") for b in ("ness", "", "xyzzy", "aaaaaaa", "日" * 9)]
    raw = [bytes([b]) for b in range(256)] + [w.encode() for w in words]
    raw += [bytes((7 * k * k + n * k + n) % 256 for k in range(n)) for n in range(2, 130)] + [b"ab" * n for n in range(1, 70)]
    return list(dict.fromkeys(raw))


def test_pieces_merge_side_by_side(monkeypatch):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = _odd_pieces()
    want = [list(bpe.merge(p, ranks)) for p in pieces]
    odd = {k: v for k, v in ranks.items() if k != b"\x07"}  # a byte without an id
    some = [k for k, p in enumerate(pieces) if 7 not in p]
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.Merged(odd).of([pieces[k] for k in some])] == [want[k] for k in some]
    monkeypatch.setattr(bpe, "_merge_short", None)  # short ones are not merged one at a time
    for limit in (3000, bpe.CACHE_BYTES):
        found = bpe.Merged(ranks, limit)
        for _ in range(2):
            assert [np.frombuffer(x, np.int32).tolist() for x in found.of(pieces)] == want
            assert found.held <= limit
    assert found.of([]) == []


def test_bytes_of_tokens_are_joined_by_arrays(monkeypatch):
    found = bpe.Merged(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    monkeypatch.setattr(bpe, "TOKENS", 3)
    pieces = _odd_pieces()
    groups = [np.frombuffer(x, np.int32) for x in found.of(pieces)]
    flat, counts = np.concatenate(groups), [len(g) for g in groups]
    assert found.decoded(flat, counts).to_pylist() == pieces
    assert found.decoded(flat[:0], [0, 0]).to_pylist() == [b"", b""] and found.decoded(flat[:0], []).to_pylist() == []
    for wrong in (-1, len(found.known)):
        with pytest.raises(KeyError):
            found.decoded(np.array([1, wrong], np.int32), [2])


@pytest.mark.parametrize("collide", [False, True])
def test_distinct_tells_pieces_apart(monkeypatch, collide):
    raw = [b"a", b"a\0", b"a", b"12345678", b"123456789", b"1234567890123456", b"12345678901234567", b"12345678901234568",
           b"x" * 40, b"x" * 41, b"x" * 40, b"12345678901234567", b"\0", b"\0\0", b"123456789"]
    values, cut = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    if collide:
        monkeypatch.setattr(pretokens, "mix", lambda x: np.zeros_like(x))
    first, number = pretokens.distinct(values, cut)
    assert [raw[first[n]] for n in number] == raw and len(first) == len(set(raw))
    assert all(raw.index(raw[k]) == k for k in first)
    assert [len(x) for x in pretokens.distinct(values[:0], np.zeros(1, np.int64))] == [0, 0]
    monkeypatch.setattr(pretokens, "slice_hashes", None)  # not asked of short ones
    assert len(pretokens.distinct(values[:4], cut[:4])[0]) == 2


def test_bounds_equal_the_library():
    import itertools

    from tokenizers import pre_tokenizers

    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    classes = np.frombuffer(zlib.decompress(tokenfiles._class_bytes(content)), np.uint8)
    texts = ["".join(t) for n in range(5) for t in itertools.product("asrev1!' \n", repeat=n)] + ["é日 \u3000's 'll've!'re''d", "\u0085 x"]
    raw = [t.encode() for t in texts]
    cut, first = pretokens.bounds(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), classes)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    at = 0
    for k, t in enumerate(texts):
        sizes = [len(t[a:b].encode()) for _, (a, b) in split(t)]
        assert np.diff(cut[first[k]:first[k + 1] + 1]).tolist() == sizes and cut[first[k]] == at, t
        at += len(raw[k])


def test_model_is_asked_once_for_each_piece():
    class Model:
        asked = []

        def tokenize(self, word):
            self.asked.append(word)
            return real.tokenize(word)

    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    tokenizer = tokenfiles._tokenizer(content)
    real, found = tokenizer.model, tokenfiles.LibraryIds(tokenizer, limit=4)
    found.model = Model()
    pieces = [b" unhappiness", b"zq", "日本".encode(), b"\n"]
    want = [tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in found.of(pieces)] == want and len(Model.asked) == 4
    known = [b"zq", b" new", b" more"]  # over the limit: the memory is emptied, what it held is not asked again
    assert [np.frombuffer(x, "<i4").tolist() for x in found.of(known)] == [want[1], *(
        tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in known[1:])]
    assert len(Model.asked) == 6 and set(found) == set(known[1:]) and found.of([]) == []


def test_scan_crosses_rows_and_texts():
    classes = pretokens.codepoint_classes()
    text = "ab" * pretokens.ROW + "  " * pretokens.ROW
    values = np.frombuffer((text + text).encode(), np.uint8)
    cut, first = pretokens.bounds(values, np.array([0, len(text), 2 * len(text)]), classes)
    assert cut.tolist() == [0, 2 * pretokens.ROW, len(text), len(text) + 2 * pretokens.ROW, 2 * len(text)]
    assert first.tolist() == [0, 2, 4]


def test_token_files(spark, docs, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        tokenizer = tokenfiles._tokenizer(file.read())
    tokenfiles.write_tokens(docs, str(tmp_path / "t"), path)
    rows = tokenfiles.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(rows) == len(TEXTS)
    want = sorted((i is not None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in TEXTS)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in rows) == want
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfiles.checksum(tokenfiles.read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert all(sums[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert {r["doc_id"] for r in tokenfiles.read_tokens(spark, str(tmp_path / "t"), [6, 7]).collect()} == {6, 7}
    tokenfiles.write_tokens(none, str(tmp_path / "none"), path)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens_in_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = file.read()
    tokenizer = tokenfiles._tokenizer(content)
    classes = np.frombuffer(zlib.decompress(tokenfiles._class_bytes(content)), np.uint8)
    texts = ["one two", "<|endoftext|>", "a<|endoftext|> é<|endoftext|><|endof", "", "日本 \n\t x's"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, counts = tokenfiles.encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets, classes, tokenfiles.LibraryIds(tokenizer))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def test_near_duplicates(spark, docs, none, real):
    rows = minhash.near_duplicates(docs).collect()
    got = {(r["id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert len(rows) == len(TEXTS)
    assert got[7, len(_shingles(TEXTS[0][1]))] == 1 and got[9, 1] == 8 and got[2, 0] == 2 and got[3, 0] == 3 and got[None, 1] is None
    assert [r["kept"] for r in rows if r["id"] == 7] == [False]
    assert minhash.near_duplicates(none).count() == 0
    # a large group of copies of several degrees, against all pairs
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(700):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 6), replace=False):
            words[k] = f"n{rng.integers(10**6)}"
        texts[i] = " ".join(words)
    sets = {i: _shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(700):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    found = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=85).collect()
    assert {r["id"]: r["component_id"] for r in found} == {i: root(i) for i in texts}


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, None), (2000, 2001), (2001, 2000), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[2001] == 2000 and got[5000] == 5000 and 1000 not in got


def test_lines(docs, none):
    rows = lines.drop_lines(docs).collect()
    got = {(r["doc_id"], r["text"]): r for r in rows}
    assert len(rows) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[10]["kept_text"] == "own 1" and by_id[10]["n_dropped"] == 1
    assert by_id[11]["kept_text"] == "own 2" and by_id[11]["n_lines"] == 3 and [tuple(x) for x in by_id[11]["keep_runs"]] == [(1, 1)]
    assert by_id[12]["kept_text"] == TEXTS[-1][1] and by_id[2]["kept_text"] == "" and by_id[2]["n_lines"] == 1
    assert got[5, LONG]["kept_text"] == LONG
    assert lines.drop_lines(none).count() == 0


def test_frequent_lines_have_the_same_result(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"a very common line of text\nown line number {k} of the text") for k in range(3000)], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_dropped"] for r in lines.drop_lines(texts).collect()}
    assert rows[2999] == 0 and all(rows[k] == 1 for k in range(2999))
    monkeypatch.setattr(lines, "OFTEN", 10**9)
    assert rows == {r["doc_id"]: r["n_dropped"] for r in lines.drop_lines(texts).collect()}


def test_merkle(spark, docs, none):
    rows = merkle.with_next(docs).withColumn("root", merkle.root(F.col("sections"))).collect()
    assert len(rows) == len(TEXTS)
    roots = {}
    for r in rows:
        roots.setdefault(r["root"], set()).add(r["text"])
    assert all(len(v) == 1 for v in roots.values())
    known = sorted({(i if i is not None else -1, t or "") for i, t in TEXTS if i is None or i not in (5,)})
    after = {(r["id"] if r["id"] is not None else -1, r["text"]): r["next_text"] for r in rows}
    for (i, t), (j, u) in zip(known, known[1:]):
        if (i, j) not in ((4, 6),):
            assert after[i, t] == u
    assert after[12, TEXTS[-1][1]] == "a row without an id"
    assert merkle.with_next(none).count() == 0
    one = spark.createDataFrame([("a\nb\n\nc\nd", "a\nB\n\nc\nd"), ("x", "x"), ("a", "a\n\nb")], "a string, b string")
    edits = one.select(merkle.differing(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).collect()
    assert [[tuple(x) for x in r["d"]] for r in edits] == [[(0, 1)], [], [(1, 0)]]


def test_quality_orders_grades(spark, docs, none, real):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(400):
        grade = k % 4
        texts.append((k, " ".join(["good" if rng.random() < grade / 3 else "bad" for _ in range(60)])))
        labels.append((k, grade))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame(labels + [(None, 1), (1, None), (9999, 3)], "doc_id long, quality int"))
    assert model.grades.tolist() == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    rows = quality.grade(df, model, least=2).collect()
    error = np.mean([abs(r["expected_grade"] - r["doc_id"] % 4) for r in rows])
    assert error < 0.5
    assert np.mean([(r["tail_probability"] >= 0.5) == (r["doc_id"] % 4 >= 2) for r in rows]) > 0.9
    assert quality.grade(docs, model).count() == len(TEXTS) and quality.grade(none, model).count() == 0
    empty = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.grade(docs, empty).where("selected").count() == len(TEXTS)


def test_toxicity_catches_held_out_words(spark, docs, none):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(600):
        words = [f"w{rng.integers(300)}" for _ in range(40)]
        if k % 4 == 0:
            words[rng.integers(40)] = ["Scum,", "idiotic", "idiots!"][k // 4 % 3]
        texts.append((k, " ".join(words), "en"))
        labels.append((k, int(k % 4 == 0)))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = toxicity.train(df, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"), use=F.col("doc_id") < 450)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in range(450, 600)]) > 0.95
    rows = toxicity.toxicity(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(none, model).count() == 0
    blank = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, blank).count() == len(TEXTS)


def test_long_texts_score_as_in_one_block():
    hashes, counts = np.arange(1, 2001, dtype=np.uint64).reshape(-1, 2), np.array([300, 700])
    model = toxicity.fit(np.concatenate([hashes] * 4), np.concatenate([counts] * 4), np.array([0, 1] * 4))
    assert np.allclose(toxicity.scores(model, hashes, counts), toxicity.scores(model, hashes, counts, block=50), atol=1e-5)


def test_languages(spark, docs, none, real):
    model = langid.train(real[0])
    found = langid.identify(real[0], model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97
    en = [r["text"] for r in found if r["lang"] == "en"][0][:400]
    de = [r["text"] for r in found if r["lang"] == "de"][0][:400]
    row = langid.identify(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and abs(row["spans"][1]["start"] - len(en)) < 40
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert rows[2]["lang_pred"] == "und" and rows[4]["lang_pred"] == "und" and rows[3]["spans"] == []
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    counts = [1, 5, 3]
    scores = rng.normal(0, 3, (sum(counts), 3))
    first = np.concatenate([[0], np.cumsum(counts)])
    path = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        value = lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert math.isclose(value(path[a:b]), max(map(value, product(range(3), repeat=b - a))))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(k, [float(x) for x in base[k % 40] + (0 if k % 7 == 0 else 0.12) * rng.normal(size=8)], k % 2) for k in range(400)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] * 4, 0), (903, [float("nan")] * 8, 0), (904, [1.0] * 8, None),
           (905, [], 0), (None, [1.0] * 8, 0), (906, [1.0] * 4, 0), (907, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r for r in hnsw.near_vectors(df).collect()}
    assert len(got) == 409
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    link = (x @ x.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400)[None, :] % 2) & ~np.eye(400, dtype=bool)
    assert [got[k]["n_links"] for k in range(400)] == link.sum(1).tolist()
    comp = np.arange(400)
    for _ in range(400):
        comp = np.array([min([comp[k], *comp[link[k]]]) for k in range(400)])
    assert [got[k]["component_id"] for k in range(400)] == comp.tolist()
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["kept"] and got[r[0]]["component_id"] == r[0] for r in odd)
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    x = hnsw._unit(np.random.default_rng(6).normal(size=(3000, 16)))
    graph = hnsw.Graph(x)
    beam = graph.audited_beam(0.8)
    q, _ = graph.within(x, 0.8, beam)
    assert len(q) >= 0.99 * (x @ x.T >= 0.8).sum()


def test_mixture_weights():
    tokens = {"a": 900, "b": 90, "c": 10}
    flat = mixing.mixture(tokens, entropy=0.9)
    assert math.isclose(flat.entropy(), 0.9 * math.log(3), rel_tol=1e-9) and math.isclose(sum(flat.weights.values()), 1)
    capped = mixing.mixture(tokens, max_repeats=4)
    assert math.isclose(max(map(capped.repeats, tokens)), 4, rel_tol=1e-9) and math.isclose(capped.repeats("a"), 1)
    with pytest.raises(ValueError):
        mixing.mixture(tokens, budget=5000, max_repeats=2)


def test_mixture_rows(spark, docs, none):
    rows = [(k, ["a", "a", "a", "a", "b", None][k % 6], "w " * (k % 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed, plan = mixing.mix_sources(df, max_repeats=2.0)
    out = mixed.collect()
    held = {f"={s}" if s else "-": sum(k % 9 for k, x, _ in rows if x == s) for s in ("a", "b", None)}
    for name, n in held.items():
        got = [r for r in out if (f"={r['source']}" if r["source"] else "-") == name]
        used = sum(r["n_tokens"] for r in got)
        part = round(plan.budget * plan.weights[name])
        assert 0 <= used - part < 9
        assert {r["doc_id"] for r in got if r["pass"] == 0} == {k for k, x, t in rows if (f"={x}" if x else "-") == name}
        order = sorted(got, key=lambda r: (r["position"], r["n_tokens"] > 0))
        seen = 0
        for r in order:
            assert math.isclose(r["position"], seen / part, abs_tol=1e-9)
            seen += r["n_tokens"]
    assert mixing.mix_sources(docs, entropy=0.9)[0].count() >= 10
    assert mixing.mix_sources(none, max_repeats=2.0)[0].count() == 0


def test_pipeline_stages(spark, real):
    import corpus_pipeline as p
    from tests.conftest import SF

    docs = real[0]
    assert [k for k, _ in p.STAGES] == ["quality", "line dedup", "near dedup", "source mixture", "byte bpe"]
    good = p.quality_filter(spark, docs, SF)
    labels = {r["doc_id"]: r["quality"] for r in real[1].collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.95 and good.columns == docs.columns
    cut = p.shared_lines(spark, good, SF)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    where = {}
    for i, t in texts.items():
        for key in {x.strip(lines.BLANKS).lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(lines.BLANKS)) for x in t.split("\n")}:
            if len(key) >= 20:
                where.setdefault(key, set()).add(i)
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(lines.BLANKS))
    want = {i: "\n".join(x for x in t.split("\n") if len(where.get(low(x), ())) < 3 or max(where[low(x)]) == i) for i, t in texts.items()}
    rows = cut.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and all(r["n_chars"] == len(r["text"]) for r in rows)
    left = {r["doc_id"] for r in p.near_duplicates(spark, cut, SF).collect()}
    sets = {i: _shingles(t) for i, t in want.items()}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert left == {i for i in ids if root(i) == i}
    final = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} == left and all(r["round_trip"] for r in final)


def test_queries_of_llm_equal_their_sql(spark):
    import duckdb

    from rowmill.llm.queries import QUERIES, SQL
    from tests.conftest import SF

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in SQL.items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
        df = QUERIES[name](spark, SF)
        assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want, name
    rows = QUERIES["op5_byte_bpe"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_mixture_keeps_documents_without_words_and_any_column(spark):
    names = ["held", "part", "begin", "src", "block", "turn", "share", "_n", "_src", "of", "load", "Weight"]
    rows = [(k, "a", "" if k >= 20 else "w w", *range(len(names))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} int" for n in names))
    out, plan = mixing.mix_sources(df, max_repeats=1.25)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40)) and plan.budget == 40
    assert set(names[:-1]) <= set(out.columns)
    for share in (0.4, 1.0, 2.5):
        out, _ = mixing.mix_sources(df.where("text <> ''"), entropy=1.0, budget_share=share)
        assert sum(r["n_tokens"] for r in out.collect()) == 40 * share
    assert mixing.mix_sources(df.where("text = ''"), max_repeats=1.25)[0].count() == 20


def test_lines_count_documents_by_id_and_keep_any_column(spark):
    line = "a line that is longer than twenty"
    rows = [(1, f"{line}\nx", 1, 2, 3), (1, f"{line}\ny", 1, 2, 3), (2, line, 1, 2, 3)]
    out = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, _llm_id int, _llm_of int, _line_id int"))
    assert all(r["n_dropped"] == 0 for r in out.collect()) and "_llm_id" in out.columns
    out = lines.drop_lines(spark.createDataFrame([*rows, (3, line, 1, 2, 3), (3, f"{line}\nz", 1, 2, 3)], "doc_id long, text string, _llm_id int, _llm_of int, of int"))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in out.collect()) == [(1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]


def test_merkle_of_line_breaks_and_edits(spark):
    texts = ["\n", "\n\n", "", " ", "one word", "\u65e5\u672c\u8a9e\u306e\u6587\u3002\u3082\u3046\u4e00\u3064\u3002", "The cat sat on the mat when rain came down and nobody was in"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    pairs = df.alias("x").join(df.selectExpr("doc_id j", "text u"), F.lit(True))
    sides = pairs.select("doc_id", "j", merkle.tree(F.col("text")).alias("a"), merkle.tree(F.col("u")).alias("b"))
    near = merkle.likeness(merkle.root(F.col("a")), merkle.marks(F.col("a")), merkle.root(F.col("b")), merkle.marks(F.col("b")))
    for r in sides.select("doc_id", "j", near.alias("near")).collect():
        assert r["near"] == (1.0 if r["doc_id"] == r["j"] else 0.0)
    text = "Some words that follow one another, in a text of several lines.\nThe second line has more of them, and ends.\n" * 3
    changed = text.replace("second", "next", 1)
    row = spark.createDataFrame([(text + "end", changed + "end", "x" + text, "Nothing here is alike at all!")], "a string, b string, c string, d string")
    tree = {c: merkle.tree(F.col(c)) for c in "abcd"}
    likes = [merkle.likeness(merkle.root(tree["a"]), merkle.marks(tree["a"]), merkle.root(tree[c]), merkle.marks(tree[c])) for c in "bcd"]
    b, c, d = row.select(*likes).first()
    assert b > 0.6 and c > 0.6 and d == 0


def test_repeated_ids_and_extreme_vectors(spark):
    a, b = [1.0, 0.1, 0.0], [0.0, 0.1, 1.0]
    rows = [(5, a, "x"), (5, b, "x"), (7, [1.0, 0.11, 0.0], "x"), (9, b, "y"), (5, b, "y"), (20, [1e200, 1e199, 0.0], "z"), (21, [1e-200, 1e-201, 0.0], "z"),
            (22, [1e-310, 1e-311, 0.0], "z"), (23, [2.0, 0.2, 0.0], "z"), (24, [1e308, -1e308, 0.0], "z")]
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], "vec_id long, embedding array<double>, label string, rep int, size string, block int")
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in hnsw.near_vectors(df).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5), (20, 3, 20), (21, 3, 20), (22, 3, 20), (23, 3, 20), (24, 0, 24)]


def test_tight_clusters_and_unreached_nodes_are_whole():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 16))
    x = hnsw._unit(np.repeat(centres, 300, axis=0) + 0.02 * rng.normal(size=(1500, 16)))
    graph = hnsw.Graph(x)
    q, node = graph.within(x, 0.93, graph.audited_beam(0.93), np.arange(1500))
    assert len(q) == (x @ x.T >= 0.93).sum()
    lost = 17
    for level in graph.links:
        level[level == lost] = -1
    q, node = graph.within(x, 0.93, 64, np.arange(1500))
    assert (node[q == lost] == lost).any() and (q == lost).sum() == (x @ x[lost] >= 0.93).sum()


def test_merging_pairs_in_arrays():
    rng = np.random.default_rng(8)
    up = np.arange(200)
    groups = {k: {k} for k in range(200)}
    for _ in range(4):
        a, b = rng.integers(0, 200, 30), rng.integers(0, 200, 30)
        up = hnsw._merge(up, a, b)
        for i, j in zip(a.tolist(), b.tolist()):
            both = groups[i] | groups[j]
            for k in both:
                groups[k] = both
        assert up.tolist() == [min(groups[k]) for k in range(200)]


def test_token_files_of_tasks_that_write_several(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        tokenfiles.write_tokens(docs, str(tmp_path / "many"), path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(tokenfiles.read_tokens(spark, str(tmp_path / "many")).collect(), key=lambda r: r["start"])
    ends = np.cumsum([r["n_tokens"] for r in rows]).tolist()
    assert [r["start"] for r in rows] == [0, *ends[:-1]] and len(rows) == len(TEXTS)
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_other_tokenizers_get_whole_texts():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        told = json.load(file)
    assert tokenfiles._by_pieces(json.dumps(told))
    told["pre_tokenizer"]["add_prefix_space"] = True
    content = json.dumps(told)
    assert not tokenfiles._by_pieces(content)
    raw = ["one two", "", "caf\u00e9  x"]
    values = np.frombuffer("".join(raw).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in raw]])
    tokenizer = tokenfiles._tokenizer(content)
    ids, counts = tokenfiles.encode_slice(values, offsets, None, tokenfiles.LibraryIds(tokenizer))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in raw]


def _text(name: str, changed: int | None = None) -> str:
    return " ".join("changed" if k == changed else f"{name}{k}" for k in range(80))


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline
    from rowmill.llm.minhash import near_duplicates

    rows = [(5, _text("a")), (5, _text("b")), (3, _text("b")), (8, _text("a", 79)), (9, _text("b", 79)), (20, _text("c")), (20, _text("d")),
            (21, _text("c", 79)), (22, _text("d", 79)), (30, _text("e")), (30, _text("e")), (31, _text("e", 79)), (40, ""), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs)
    kept = sorted((r["id"], r["n_shingles"]) for r in found.where("kept").collect())
    assert kept == [(3, 76), (5, 76), (20, 76), (20, 76), (30, 76), (40, 0), (40, 0)]
    assert found.groupBy("component_id", "component_of").count().where("component_id < 40").count() == 5
    left = sorted((r["doc_id"], r["text"][:1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left == [(3, "b"), (5, "a"), (20, "c"), (20, "d"), (30, "e"), (40, ""), (40, "")]
