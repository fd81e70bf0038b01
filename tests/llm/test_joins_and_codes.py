"""Vector codes, the Jaccard join and the prefix trie against brute force and against their SQL."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import ann, codebooks, common, jaccard, queries, simhash, token_files, toxicity, tries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_licenses", "op11_codebooks", "op12_jaccard", "op13_tries"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


# --- earlier operators: strips, hot ids, huge values, naive scores
def plain_fingerprint(text):
    words = text.lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("size", [1, 5, 40, 1 << 20])
def test_fingerprints_don_t_depend_on_strips(monkeypatch, size):
    monkeypatch.setattr(common.strips, "__defaults__", (size,))
    rng = random.Random(size)
    for n in (0, 1, 2, 3, 4, 60, 400):
        text = b" \n".join(rng.choice([b"Aa", b"b", b"cc", b"d" * 9]) for _ in range(n)) + b" "
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_is_bounded_in_memory():
    """20 MB of one-letter words: a few strips' worth of memory, not a Python object for each word."""
    text = b"a b c d e f g h i j " * 1_000_000
    tracemalloc.start()
    simhash.fingerprint(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250e6


def test_one_doc_id_is_dealt_over_many_files(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(400)] + [(i, "x") for i in range(100)] + [(None, f"null {i}") for i in range(200)]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.TOKENIZER)
    read = token_files.read_token_files(spark, path)
    assert read.where("doc_id = 7").select("file").distinct().count() > 1
    ids = [r["doc_id"] for r in read.orderBy("file", "row").collect()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == 700


def test_neighbours_of_huge_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 1e160
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(docs, docs["vec_id"] % 100 == 0).collect()
    assert len(got) == 30
    for q in (0, 100, 200):
        far = {i: 1e160 * float(np.sqrt((((x[i] - x[q]) / 1e160) ** 2).sum())) for i in range(300) if i != q}
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len({i for _, i, _ in own} & set(sorted(far, key=far.get)[:10])) >= 8 and all(s == pytest.approx(far[i], rel=1e-9) for _, i, s in own)


def test_toxicity_scores_equal_naive_ones():
    """The score by dictionaries of n-grams: scaled presence of the features that the model holds."""
    rng = random.Random(5)
    word = lambda bad: "".join(rng.choice("xyzq" if bad else "abcdefgh") for _ in range(6))
    rows = [(" ".join(word(k % 4 == 0 and rng.random() < 0.5) for _ in range(30)) + "!?", int(k % 4 == 0)) for k in range(200)]
    model = toxicity.fit(rows)
    assert model.square.any()
    texts = [t for t, _ in rows[:20]] + ["", "Xyzq, XYZQ!", "a-b_c ... d", "é€😀 x"]
    got = toxicity.probabilities(model, texts)
    for t, p in zip(texts, got, strict=True):
        clean = " " + " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split()) + " "
        seen = {int(toxicity.grams(np.array([ord(c) for c in clean[i : i + n]], dtype=np.uint32), n)[0]) for n in toxicity.ORDERS for i in range(len(clean) - n + 1)}
        held = [f for f in seen if model.square[f]]
        z = sum(float(model.theta[f]) for f in held) / np.sqrt(1 + sum(float(model.square[f]) for f in held)) + model.c
        assert p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


# --- vector codes
def plain_codes(vectors, entries=64, rounds=2):
    """The contract in Python's integers: (codes, error) by id, and the digest."""
    kept = sorted((i, [floor(256 * Fraction(x)) for x in v]) for i, v in vectors.items())
    size = max(len(v) for _, v in kept)
    size = -(-size // 16)
    part = lambda v, p: (v + [0] * (16 * size - len(v)))[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            own = defaultdict(list)
            for _, v in kept:
                own[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = {}
    for i, v in kept:
        found = [near(part(v, p), books[p]) for p in range(16)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("case", ["even", "few", "odd", "huge", "tied"])
def test_codes_equal_plain_lloyd(spark, case):
    rng = np.random.default_rng(3)
    n, dim = {"even": (150, 32), "few": (20, 16), "odd": (90, 21), "huge": (80, 16), "tied": (200, 16)}[case]
    x = rng.normal(size=(n, dim))
    x = {"huge": x * 10.0 ** rng.integers(0, 12, (n, 1)), "tied": rng.integers(-1, 2, (n, dim)) / 256}.get(case, x)
    vectors = {i: [float(v) for v in row[: dim - (i % 3 if case == "odd" else 0)]] for i, row in enumerate(x)}
    bad = [(1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, None), (1003, [float("inf")] * dim, 2)]
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in vectors.items()] + bad
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = codebooks.with_label_error(codebooks.vector_codes(docs)).collect()
    want, digest = plain_codes(vectors)
    fits = lambda e: e if e < 1 << 63 else None
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {i: (c, fits(e)) for i, (c, e) in want.items()}
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = defaultdict(int)
    for i, (_, e) in want.items():
        sums[None if i % 5 == 0 else i % 3] += e
    assert all(r["label_error"] == fits(sums[r["label"]]) for r in got)


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4000, (64, 8)).round()
    x = (centres[rng.integers(0, 64, 3000)] + rng.normal(0, 50, (3000, 8))).round()
    group = codebooks.grouped(centres)
    code, _, lower, taken = codebooks.assign(x, centres, group)
    assert taken == 3000 * 64
    moved = centres + rng.integers(-3, 4, centres.shape)
    drift = codebooks.moves(centres[None], moved[None], group[None])[0, : group.max() + 1]
    got, far, _, taken = codebooks.assign(x, moved, group, code, lower, drift)
    d = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    assert taken < 0.35 * 3000 * 64


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(6)
    book, x = rng.integers(-9, 9, (40, 3)).astype(float), rng.integers(-9, 9, (500, 3)).astype(float)
    group = codebooks.grouped(book)
    code, lower, drift = None, None, None
    for _ in range(6):
        code, far, lower, _ = codebooks.assign(x, book, group, code, lower, drift)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        rest = np.sqrt(d)
        rest[np.arange(len(x)), code] = np.inf
        assert all((lower[:, g] <= rest[:, group == g].min(axis=1, initial=np.inf)).all() for g in range(group.max() + 1))
        new = book + rng.integers(-2, 3, book.shape)
        book, drift = new, codebooks.moves(book[None], new[None], group[None])[0, : group.max() + 1]


def test_limbs_and_rounding():
    for v in (0, 1, -1, 2**31, -(2**31) - 1, 2**200 + 5, -(3**150)):
        assert sum(x << (32 * i) for i, x in enumerate(codebooks.limbs(v))) == v and all(-(2**31) <= x < 2**32 for x in codebooks.limbs(v))
    assert codebooks.integers(pa.array([[0.5, -0.001, 1e300]] * 2, pa.list_(pa.float64())), 16)[1, :3].tolist() == [128, -1, int(1e300) * 256]


# --- Jaccard join
def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)].append(i)
    return [(i, len(s), min(least[top(k)], default=None) if s else i) for k, (i, s) in enumerate(sets)]


def near_copies():
    """Texts with edits of every size around the threshold, chains, subsets, shared passages, short and empty ones."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, passage = [], text(60)
    for _ in range(12):
        base = text(rng.choice([8, 30, 90, 200]))
        out.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy if rng.random() < 0.7 else copy[: int(len(copy) * rng.uniform(0.75, 0.95))])
    chain = text(150)
    for _ in range(25):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        out.append(chain)
    out += [text(40) + passage + text(40) for _ in range(30)] + [passage + text(2) for _ in range(4)]
    out += [[], ["one"], ["one"], ["One"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["x"] * 50, ["x"] * 9]
    return [" ".join(t) for t in out]


def test_jaccard_equals_all_pairs(spark):
    texts = [*near_copies(), None, " \t\n", "Ä ä é one two", "ä Ä é one two"]
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (5000, texts[0].upper()), (None, texts[1]), (None, "no other text has these five words")]
    docs = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in rows], "doc_id long, text string, n long, node string, key long")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain_components(rows), key=repr)


def test_a_large_group_of_copies_is_linked_without_all_pairs(spark):
    """600 different copies of one text, many of them not alike enough to link: the components are those of all pairs."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(600):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(plain_components(rows))


def test_shingles_of_long_texts_don_t_depend_on_strips(monkeypatch):
    texts = [b"", b"a", b"a b c d", b"a b c d e", b" a  b\tc\nd e f ", b"word " * 400, b"x" * 500 + b" y " * 30, " ".join(f"t{k}" for k in range(300)).encode()]
    whole = [jaccard.shingle_set(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(common.strips, "__defaults__", (size,))
        for t, w in zip(texts, whole, strict=True):
            assert jaccard.shingle_set(t).tolist() == w.tolist()
    assert [len(w) for w in whole] == [len(shingles(t.decode())) for t in texts]


# --- prefix trie
def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], sha(k, m)) for k, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_nodes(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, name int, sym string")
    out = tries.trie(frame)
    assert out.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


@pytest.mark.parametrize("longest", [1, 3, 8, 13])
def test_trie_equals_a_plain_one(spark, longest):
    rng = random.Random(longest)
    rows = []
    for c in rng.sample(range(450), 150):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ä€😀", ""])))
    rows += [(600, None, None, None), (600, 0, "user", None), (600, 0, "user", None), (600, 0, "user", "z"), (601, 5, "assistant", "q"), (None, 0, "user", "lost"), (700, 1, "user", "only")]
    assert found_nodes(spark, rows) == plain_trie(rows)


def test_trie_of_a_long_conversation_and_of_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(tries, "DEPTHS", 16)
    monkeypatch.setattr(tries, "IDS", 7)
    rows = [(5, t, "user", f"t{t % 5}") for t in range(75)] + [(c, t, "user", f"t{t % 5}") for c in range(1000, 1060) for t in range(9)] + [(7, 1, "user", "same")] * 20
    assert found_nodes(spark, rows) == plain_trie(rows)
