"""Every registered query of the corpus operators, and the pipeline's ``run``, on odd tables and on empty ones."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, label int, part int, length long, h long, piece int, start long, digest string",
    "labels": "doc_id long, quality int, toxic int, text string, score double",
    "pages": "page_id long, url string, html string, text string, n_chars long",
    "benchmark": "item_id long, text string, doc_id long",
    "embeddings": "vec_id long, embedding array<float>, label int, query_id long, rank int, part int",
    "conversations": "conv_id long, turn long, role string, text string, d int, name string",
}
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_licenses": {"doc_id": "bigint"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_decontamination": {"doc_id": "bigint"},
    "op11_codebooks": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op13_tries": dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint") | {"ends_sha256": "string"},
}
LEAK = "the harbour master counts every lantern twice before the winter ferry leaves its mooring"


def texts():
    rng = random.Random(11)
    good = lambda n: " ".join(rng.choice(["harbour", "lantern", "winter", "ferry", "garden", "letter", "window"]) for _ in range(n)).capitalize() + "."
    junk = lambda n: "buy now " * n
    many = [good(30) if i % 3 else junk(15) for i in range(60)]
    return [None, "", "  \n", *many, many[1], many[1], many[1].upper(), good(4000), f"{good(20)} {LEAK} {good(20)}", "é ß <|endoftext|> ñ", "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with null ids and values, repeated ids and rows, empty and long texts, and clashing columns."""
    docs = [(i, t, None, "s", None, 9.0, 3, 2, 5, 1, 4, 8, "d") for i, t in enumerate(texts())]
    docs += [docs[5], docs[5], (7, "another text under the same id", *docs[0][2:]), (None, "no id here", *docs[0][2:]), (None, None, *docs[0][2:]), (None, LEAK, *docs[0][2:])]
    rows = {
        "documents": docs,
        "labels": [(i, int(i % 3 != 0), i % 2, "t", 0.1) for i in range(3, 63)] + [(4, None, None, None, None), (None, 1, 1, None, None), (5, 1, 0, None, None), (5, 1, 0, None, None), (6, 7, -1, None, None)],
        "pages": [(1, "u", "<article><h1>A  title</h1><p>One &amp; two.</p></article>", "x", 4), (1, "u", None, "x", 4), (None, None, "", None, None), (2, None, "<p>open <b>tags", None, None), (3, "v", "<<<>>&bogus; <a", None, None)],
        "benchmark": [(1, LEAK, 4), (2, None, None), (3, "", None), (None, "an item that has no id of its own at all", None), (1, LEAK, 4)],
        "embeddings": [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)], 1, 2, 3, 4) for i in range(120)]
        + [(200, None, 1, 2, 3, 4), (300, [0.0] * 6, 1, 2, 3, 4), (400, [float("nan")] * 6, 1, 2, 3, 4), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 2, 3, 4), (501, [float("inf")] * 6, 1, 2, 3, 4)],
        "conversations": [(1, 0, "user", "hello", 9, "n"), (1, None, None, None, 9, "n"), (1, None, None, None, 9, "n"), (None, 0, "user", "x", 9, "n"), (100, 3, "user", "y" * 100000, None, None)],
    }
    return write(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("bare"), dict.fromkeys(TABLES, []))


def write(spark, path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def gapless(places):
    at = {}
    for group, start, length in sorted(places):
        assert start == at.get(group, 0)
        at[group] = start + length
    return at


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, bare, name):
    out = corpus_pipeline.run(spark, bare) if name == "pipeline" else QUERIES[name](spark, bare)
    assert COLUMNS["op4_packing" if name == "pipeline" else name].items() <= dict(out.dtypes).items()
    assert out.collect() == []


@pytest.mark.parametrize("name", QUERIES)
def test_odd_tables(spark, odd, name):
    out = QUERIES[name](spark, odd)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    assert len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    by_id = lambda x: (x is None, x or 0)
    if name not in ("op3_html", "op4_packing", "op9_neighbours", "op10_decontamination", "op11_codebooks", "op13_tries"):
        assert sorted((r["doc_id"] for r in rows), key=by_id) == sorted((i for i, _ in docs), key=by_id)
    if name in ("op1_quality", "op8_toxicity"):
        n, rest = (3, 1) if name == "op1_quality" else (5, 0)
        for r in rows:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
            assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest)
    elif name == "op2_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in rows)
        assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
        assert all(r["component_id"] <= r["doc_id"] for r in rows if r["doc_id"] is not None)
    elif name == "op3_html":
        assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
        assert {r["text"] for r in rows if r["page_id"] == 1} == {"", "A title\n\nOne & two."}
    elif name == "op4_packing":
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = []
        for i, t in docs:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            found = [(r["start"], r["length"]) for r in rows if r["doc_id"] == i]
            want.append((i, len(ids)))
            if i is not None and [d for d, _ in docs].count(i) == 1:
                gapless([(0, s, n) for s, n in found])
                assert all(n <= 1024 for _, n in found) and sum(n for _, n in found) == len(ids) and len(found) == -(-len(ids) // 1024)
                assert {(r["start"], r["ids_crc32"]) for r in rows if r["doc_id"] == i} == {(s, zlib.crc32(ids[s : s + n].tobytes())) for s, n in found}
        assert sum(r["length"] for r in rows) == sum(n for _, n in want)
        assert max(gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows]).values()) <= 1024
    elif name == "op6_sharding":
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in docs)
        assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in rows)
        gapless([(r["shard"], r["slot"], 1) for r in rows])
    elif name == "op7_token_files":
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in docs]
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(w) // 4, zlib.crc32(w)) for w in want)
        gapless([(0, r["start"], r["n_tokens"]) for r in rows])
        known = sorted((r["start"], r["doc_id"]) for r in rows if r["doc_id"] is not None)
        assert [i for _, i in known] == sorted(i for _, i in known)
    elif name == "op9_neighbours":
        vectors = {i: np.array([float(x) for x in np.random.default_rng(i).normal(size=6)], "f4").astype(float) for i in range(120)}
        for q in (0, 100):
            far = {i: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for i, v in vectors.items() if i != q}
            found = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
            assert [r for r, _, _ in found] == list(range(1, 11)) and len({i for _, i, _ in found}) == 10
            assert all(x == pytest.approx(far[i], rel=1e-12) for _, i, x in found)
            assert [(x, i) for _, i, x in found] == sorted((x, i) for _, i, x in found)
        assert {r["query_id"] for r in rows} == {0, 100}
    elif name == "op11_codebooks":
        assert sorted(r["vec_id"] for r in rows) == [*range(120), 300] and all(len(r["code"]) == 32 for r in rows)
    elif name == "op12_jaccard":
        assert {r["component_id"] for r in rows if r["doc_id"] in (4, 63, 64)} == {4}
        assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (0, 1, 2))
    elif name == "op13_tries":
        assert [(r["conv_id"], r["n_convs"]) for r in rows if r["depth"] == 0] == [(1, 2)]
    elif name == "op10_decontamination":
        leaks = [i for i, t in docs if LEAK in t]
        assert {r["doc_id"] for r in rows} == set(leaks) and None in leaks


def test_pipeline_on_odd_tables(spark, odd):
    """What run() packs are whole documents that no stage rejects; neither leak nor copy is among them."""
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, odd).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{odd}/documents.parquet").where("doc_id is not null").collect()}
    assert kept - {None} <= set(docs)
    assert not [i for i in kept if i is not None and LEAK in docs[i]]
    assert len(kept & {4, 63, 64}) <= 1
