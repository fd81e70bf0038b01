"""Each operator against brute force on small fixtures, with the odd rows any corpus has."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, html, licenses, packing, quality, sharding, simhash, token_files, tokens, toxicity
from tidemark.llm.common import components, shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Columns whose names the operators use inside.
ODD = "score double, fp long, part int, length long, label int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {ODD}"


def words(rng, n):
    return " ".join(rng.choice(["ka", "mel", "tor", "isu", "ban", "ledi", "vor"]) + rng.choice(["na", "ti", "sol", "ra"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, n) for n in (1, 2, 3, 40, 60, 200, 90)]
    near = [base[5].replace(" ", "  ", 1), base[5].upper(), base[5] + " x", " ".join(base[5].split()[:-1])]
    texts = [None, "", " \n\t", *base, *near, *[base[3]] * 5, words(rng, 9000), "é ß <|endoftext|> ñ", "a   b  c\n \nd"]
    return [(i, t, "en", None, None, 0.5, 7, 1, 9, 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_groups(prints):
    label = dict.fromkeys(prints)
    for i in prints:
        if label[i] is None:
            todo = [i]
            label[i] = i
            while todo:
                a = todo.pop()
                for b in prints:
                    if label[b] is None and (prints[a] ^ prints[b]).bit_count() <= 3:
                        label[b] = i
                        todo.append(b)
    return label


def test_simhash(docs, rows, empty):
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).select("doc_id", simhash.hex_of("fp").alias("f"), "component_id").collect()}
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    assert {i: r["f"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_groups(prints)
    assert simhash.near_groups(empty).count() == 0


def test_simhash_links_lose_none(spark):
    rng = random.Random(5)
    made = []
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            made.append(f)
            for _ in range(rng.randrange(0, 4)):
                f ^= 1 << rng.randrange(64)
    block = rng.getrandbits(64)
    made += [block, block ^ 0b111, block ^ 0b111 << 30 ^ 1 << 63]  # three bits inside one block
    prints = dict(enumerate(dict.fromkeys(made)))
    found = components(simhash.near_links(spark.createDataFrame([(simhash.signed(p),) for p in prints.values()], "fp long")).select("a", "b"))
    of = {r["node"]: r["component"] for r in found.collect()}
    want = slow_groups(prints)
    got = {i: of.get(simhash.signed(p), simhash.signed(p)) for i, p in prints.items()}
    assert len(set(zip(got.values(), want.values(), strict=True))) == len(set(got.values())) == len(set(want.values()))


def test_dedup_keeps_one_of_each_group(docs, rows, spark, empty):
    twice = docs.unionByName(docs.where("doc_id = 6")).unionByName(spark.createDataFrame([(None, "no id", *[None] * 8)], DOCS))
    kept = simhash.dedup_near(twice)
    assert kept.columns == docs.columns
    want = {r[0]: slow_fingerprint(r[1]) for r in rows}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({*slow_groups(want).values(), None})
    assert simhash.dedup_near(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_token_ids_equal_the_librarys(monkeypatch):
    t = Tokenizer.from_file(PATH)
    texts = ["", " x", "x ", "  ", "a   b  c", "a\n \nb", "\n\n a", "a \n b\t c!  ", "don't 'll  it's", "<|endoftext|> hi", "é  ñ\x1c b!\x1c x", "word " * 300]
    rng = random.Random(12)
    bits = [*" \n\t\x1c\u00a0\u0085\u2003\u3000\u200b", " \n", "\r\n", *"abéàß漢١²Ⅷ_'.3", "word", "'s", "'ll", "!!", "<|endoftext|>", "e\u0301", "😀"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2000)] + [None]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for strip, kept in ((1 << 20, 1000), (64, 50)):
        monkeypatch.setattr(tokens, "STRIP", strip)
        monkeypatch.setattr(tokens, "KEPT", kept)
        ids, at = tokens.Encoder(PATH).encode(pa.array(["not in it", *texts])[1:])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert [x.tolist() for x in tokens.ended(pa.array([], pa.string()), PATH, 2)] == [[], [0]]
    ids, at = tokens.ended(pa.array(["", None, "a"]), PATH, 2)
    assert ids.tolist() == [2, 2, *t.encode("a").ids, 2] and at.tolist() == [0, 1, 2, 4]


def test_unknown_cuts_go_to_the_library_many_at_a_time(monkeypatch):
    calls = []

    class Counted:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return self.own.encode_batch_fast(texts, **options)

    texts = [f"w{'abc'[k % 3] * (k % 40)}\u00e9{k}, {k} \u6f22{k}\n" + "#" * (k % 90) for k in range(1500)] + ["", " ", "a\u00a0b \u2003c\u0085 d\x1c e", "\u1e9e\u0250 x"]
    for kept in (tokens.KEPT, 100):
        monkeypatch.setattr(tokens, "KEPT", kept)
        made = tokens.Encoder(PATH)
        library, made.tokenizer = made.tokenizer, Counted(made.tokenizer)
        for part in (texts, texts[::-1]):
            ids, at = made.encode(pa.array(part))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in part]
        assert max(len(made.new), len(made.old)) <= kept
    assert 100 < max(calls) <= 256


def test_packing(docs, rows, empty):
    t = Tokenizer.from_file(PATH)
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = packing.pack_documents(docs, PATH).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, x in ids.items():
        p = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [v for r in p for v in np.frombuffer(r["ids"], "<u4")] == x
        assert [r["start"] for r in p] == list(np.cumsum([0, *[r["length"] for r in p]])[:-1])
        assert all(r["length"] == 1024 for r in p[1:]) and (len(x) > 1024 or len(p) == 1)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0, *[r["length"] for r in s]])[:-1]) and sum(r["length"] for r in s) <= 1024
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("share", packing.SHARES)
@pytest.mark.parametrize("groups", packing.GROUPS)
def test_plan_places_every_piece_once(groups, share):
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 101, 3000).tolist()) | Counter({100: 40, 51: 300})
    n, plan = packing.plan(dict(histogram), 100, packing.grouped(histogram, 100, groups), share)
    used = {}
    for length, lo, hi, first, each, offset in plan:
        for t in range(hi - lo):
            used.setdefault(first + t // each, []).append((offset + t % each * length, length))
    assert Counter(length for s in used.values() for _, length in s) == Counter(histogram)
    for s in used.values():
        s.sort()
        assert all(a + x == b for (a, x), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and sum(s[-1]) <= 100
    assert set(used) == set(range(n))


def best_fit(histogram, capacity):
    rooms, n = Counter(), 0
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            r = min((r for r in rooms if r >= x and rooms[r]), default=0)
            rooms[r] -= bool(r)
            n += not r
            rooms[(r or capacity) - x] += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_as_tight_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    made = (rng.integers(1, 1024, 3000), rng.integers(300, 700, 2000), rng.choice([341, 342, 511, 513, 170], 3000), np.minimum(1023, rng.lognormal(5, 1, 4000).astype(int) + 1))[seed]
    histogram = Counter(made.tolist())
    assert packing.best_plan(histogram, 1024)[0] <= best_fit(histogram, 1024) + 1


def test_token_files(spark, docs, rows, empty):
    t = Tokenizer.from_file(PATH)
    for delta in (True, False):
        path = f"{shared_dir(spark).removeprefix('file://')}/files-{delta}"
        token_files.write_token_files(docs, path, PATH, delta=delta)
        got = {r["doc_id"]: r for r in token_files.with_starts(token_files.digests(token_files.read_token_files(spark, path))).collect()}
        at = 0
        for r in rows:
            x = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
            assert (got[r[0]]["start"], got[r[0]]["n_tokens"], got[r[0]]["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
            at += len(x)
        parts = sorted(Path(path).glob("*.parquet"))
        for x in parts:
            meta = pq.ParquetFile(x).metadata
            for g in range(meta.num_row_groups):
                assert meta.row_group(g).total_byte_size < 2 * token_files.ROW_GROUP
                for c in (meta.row_group(g).column(k) for k in range(meta.num_columns)):
                    assert c.has_column_index and c.has_offset_index and (not delta or "DELTA_BINARY_PACKED" in c.encodings)
        assert delta or any("DICTIONARY" in e for x in parts for m in [pq.ParquetFile(x).metadata] for g in range(m.num_row_groups) for e in m.row_group(g).column(2).encodings)
        some = spark.read.parquet(path).where("doc_id BETWEEN 5 AND 7").select("doc_id", "tokens")
        assert {r["doc_id"]: r["tokens"] for r in some.collect()} == {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows if 5 <= r[0] <= 7}
    tied = spark.createDataFrame([(1, "a b c d"), (1, "a"), (1, "a b c"), (None, "x y"), (None, "x")], "doc_id long, text string")
    path = f"{shared_dir(spark).removeprefix('file://')}/files-tied"
    token_files.write_token_files(tied, path, PATH)
    lists = [r["tokens"] for x in sorted(Path(path).glob("*.parquet")) for r in pq.read_table(x).to_pylist()]
    starts = {(zlib.crc32(np.array(x, "<u4").tobytes()), sum(map(len, lists[:k]))) for k, x in enumerate(lists)}
    assert starts == {(r["ids_crc32"], r["start"]) for r in token_files.with_starts(token_files.digests(token_files.read_token_files(spark, path))).collect()}
    token_files.write_token_files(empty, f"{shared_dir(spark)}/files-none", PATH)
    assert token_files.with_starts(token_files.digests(token_files.read_token_files(spark, f"{shared_dir(spark)}/files-none"))).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(docs, rows, empty, shards):
    got = {r["doc_id"]: r for r in sharding.shard_by_bytes(docs, shards).collect()}
    import hashlib

    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    group = {r[0]: "0" * 64 if r[1] is None else hashlib.sha256(r[1].encode()).hexdigest() for r in rows}
    assert {i: r["size"] for i, r in got.items()} == size
    assert {i: r["text_crc32"] for i, r in got.items()} == {r[0]: zlib.crc32((r[1] or "").encode()) for r in rows}
    sums = [sum(size[i] for i in size if group[i] == g) for g in sorted(set(group.values()))]

    def fits(c):
        n, held = 1, 0
        for s in sums:
            n, held = (n + 1, s) if held + s > c else (n, held + s)
        return max(sums) <= c and n <= shards

    best = next(c for c in range(max(sums), sum(sums) + 1) if fits(c))
    load = Counter()
    for i, r in got.items():
        load[r["shard"]] += size[i]
    assert max(load.values()) <= best and 0 <= min(load) and max(load) < shards
    assert len({(group[i], r["shard"]) for i, r in got.items()}) == len(set(group.values()))
    for s in load:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    assert sharding.shard_by_bytes(empty, shards).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy this, now.</div>
<article><h1>Title &amp; more</h1><p><b>First  part,<br>of it.<p>Second\tpart &eacute;.</article><aside>Side.</aside><section id="comments"><p>Nice, really.</section><form>Send</form><footer>&copy; x.</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE, 1.0), (2, "u", None, 1.0), (3, None, "", 1.0), (4, "u", "plain &lt; text", 1.0), (1, "u", PAGE, 1.0), (5, "u", "<p>" + "long words, here. " * 40000, 1.0), (6, "u", "<nav>only</nav>", 1.0), (7, "u", "<", 1.0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text double")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[1] == "Title & more\n\nFirst part, of it.\n\nSecond part é."
    assert (text[2], text[3], text[4], text[6]) == ("", "", "plain < text", "")
    assert len(text[5]) == 18 * 40000 - 1
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "<p>" + "A long sentence about it, and more of it here. " * 13 + "</p>"
SHORT = ["<ul>" + "<li>five words without any mark</li>" * 5 + "</ul>", "<table><caption>the years</caption><tr><th>year<td>1999</table>", "<dl><dt>term<dd>what it means</dl>", "<figure><img src=x><figcaption>a small harbour</figcaption></figure>"]


@pytest.mark.parametrize("around", ["{}", "<article>{}</article>", "<div><div>{}</div></div>"])
def test_html_keeps_short_blocks_beside_long_ones(around):
    for short in SHORT:
        got = html.main_text("<html><body>" + around.format("<h1>Some title of it</h1>" + LONG * 3 + short) + "</body></html>")
        want = [x for x in html.re.sub(r"<[^>]*>", "\n", short).split("\n") if x]
        assert got.startswith("Some title") and got.split("\n\n")[4:] == want


@pytest.mark.parametrize("wrapper", ["<form>", "<div class='has-sidebar'>", "<div class='content header-fixed'>", "<div class='post no-comments'>", "<div id='notice-123'>", "<div class='social-science'>", "<div class='widget'>"])
def test_html_furniture_names_on_a_wrapper(wrapper):
    text = "Some words of the page, of which there are many."
    close = "</form>" if wrapper == "<form>" else "</div>"
    for inner in (f"<p>{text}</p>", f"<article><p>{text}</p></article>"):
        assert html.main_text(f"<body><nav>Menu</nav>{wrapper}{inner}{close}<div class='ad'>Buy.</div></body>") == text
    assert html.main_text(f"<body><main><p>{text}</p></main><div class='widget'>{text}{text}</div></body>") == text


def test_html_furniture_without_end_tags():
    text = "Some words of the page, of which there are many."
    for page in (
        f"<article><p class='notice'>Take note.<p>{text}</article>", f"<article><div><p class='notice'>Take note.</div><p>{text}</article>", f"<article><ul><li class='social'>Like it<li>{text}</ul></article>",
        f"<article><p>{text}</p><svg/><p>{text}</article>", f"<article><p>{text}<span class='share'>Share <span>it</span> now</span> And more.</article>", f"<head><title>T</title><body><p>{text}",
    ):
        want = {"<svg/>": f"{text}\n\n{text}", "'share'": f"{text} And more."}
        assert html.main_text(page) == next((w for k, w in want.items() if k in page), text)


def test_html_furniture_without_a_name_goes_by_its_ratio():
    text = "".join(f"<p>Some sentence of the page, and then more of it, number {k}. And another one.</p>" for k in range(6))
    links = "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(8))
    for page in (f"<div class=x1><ul>{links}</ul></div><div class=x2>{text}</div><div class=x3>Like it</div>", f"<div class=x1>Buy this thing now, or else.</div><article>{text}</article><div class=x3>Some notice of the law, of one line.</div>"):
        got = html.main_text(f"<html><body>{page}</body></html>")
        assert got.split("\n\n") == [x for x in html.re.sub(r"<[^>]*>", "\n", text).split("\n") if x]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
@pytest.mark.parametrize("tags", [False, True])
def test_html_names_and_tags_are_only_a_feature(monkeypatch, tags):
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()[:1200]
    article = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x[x.index("<article>") : x.index("</article>")]))).strip() if "</article>" in (x or "") else None for x in pages]
    want = [html.main_text(x) for x in pages]
    assert sum(a is not None for a in article) > 1000 and all(a is None or a.split() == w.split() for a, w in zip(article, want, strict=True))
    monkeypatch.setattr(html, "NAMES", frozenset())
    if tags:
        monkeypatch.setattr(html, "ROLES", frozenset())
        monkeypatch.setattr(html, "DROPPED", html.RAW | {"head"})
    assert sum(html.main_text(x) != w for x, w in zip(pages, want, strict=True)) <= 0.005 * len(pages)


def test_licenses(spark):
    mit = licenses.MIT.replace("\n", "\n  ").upper().replace("SUBLICENSE", "sub-licence")
    rows = [(1, "Copyright (c) 2020 A. Nother\n\n" + mit, "x"), (2, "Prose.\nReleased under the MIT licence!\nLicensed under CC BY 4.0.", "x"), (3, None, "x"), (4, "", "x"), (2, "Prose.", "x"), (5, "word " * 200000, "x"), (6, licenses.BSD_CONDITIONS + licenses.BSD_DISCLAIMER, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"], r["license"], r["line_licenses"]) for r in got if r["doc_id"] != 2) == [(1, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, "BSD-2-Clause", "")]
    assert sorted(r["line_licenses"] for r in got if r["doc_id"] == 2) == ["", "CC-BY-4.0,MIT"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_in_hard_wrapped_files(spark):
    def at(text, *starts):  # lines that start with these words
        for x in starts:
            assert f" {x}" in text
            text = text.replace(f" {x}", f"\n{x}", 1)
        return text

    mit, isc = at(licenses.MIT, "copyright notice", "COPYRIGHT HOLDERS BE"), at(licenses.ISC, "copyright notice and")
    bsd = licenses.BSD_CONDITIONS + at(licenses.BSD_DISCLAIMER, "COPYRIGHT HOLDERS AND", "COPYRIGHT HOLDER OR")
    heads = ["", "Copyright (c) 2020 A. Nother\n\n", "Copyright 2019-2021, A. Nother.\nAll rights reserved.\n\n", "Copyright A. Nother\nCopyright The Others\n\n", "(c) 2020 A. Nother\n", "\u00a9 A. Nother\n\n"]
    unlicense = at(licenses.UNLICENSE + licenses.UNLICENSE_REST, "copyright interest", "copyright law.").replace("https:", "http:")
    texts = [(name, head + t) for head in heads for name, t in (("MIT", mit), ("ISC", isc), ("BSD-2-Clause", bsd))] + [("Unlicense", unlicense), ("MIT", "MIT License\n\nCopyright A. Nother\n\n" + mit)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


FILES = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FILES.exists(), reason="no license files")
def test_licenses_of_whole_files(spark):
    names = {f: f for f in ("Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "LGPL-2.1", "MPL-1.1", "MPL-2.0")}
    names |= {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"}
    texts = [(names[f.name], f.read_text()) for f in FILES.iterdir() if f.name in names and not f.is_symlink()]
    end = "END OF TERMS AND CONDITIONS"
    texts += [(n, part) for n, t in texts if end in t for part in (t[: t.index(end)], t[: t.index(end) + len(end)])]
    texts += [(n, "\n".join(f"  {x.strip()}" for x in t.upper().replace("HTTPS", "HTTP").splitlines())) for n, t in texts]
    texts += [(n, t.replace("[yyyy] [name of copyright owner]", "2021 A. Nother")) for n, t in texts if n == "Apache-2.0"]
    near = [(None, t.replace(" not ", " ", 1)) for n, t in texts if " not " in t] + [(None, t + "\nNo other terms.") for _, t in texts]
    bullets = [(n, re.sub(r"\n\d\. ", "\n - ", t)) for n, t in licenses.TEXTS if n.startswith("BSD")]
    rows = texts + near + bullets
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert len(texts) > 20 and [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def labelled(rng, n):
    out = []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = words(rng, rng.randrange(20, 200)).split()
        if toxic:
            for _ in range(2 + len(w) // 25):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgface", "grimblat"]))
        out.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w), int(not bad), int(toxic)))
    return out


def slow_probability(net, text):
    """One chunk after the other."""
    raw = text + bytes(-len(text) % quality.STEP + quality.PAD)
    rep = [any(i - quality.RUN + 1 - lag >= 0 and all(raw[j] == raw[j - lag] for j in range(i - quality.RUN + 1, i + 1)) for lag in quality.LAGS) and raw[i] != 0 for i in range(len(raw))]
    code = np.array([x + 256 * r for x, r in zip(raw, rep, strict=True)] + [0] * quality.STEP)
    top = np.max([net.emb[code[a : a + 2 * quality.STEP]].ravel() @ net.w for a in range(0, len(raw), quality.STEP)], axis=0) + net.b
    return 1 / (1 + np.exp(-float(np.maximum(top, 0) @ net.v + net.c)))


def test_quality_scores_whole_texts_in_strips(monkeypatch):
    rng = random.Random(5)
    net = quality.fit([(t, q) for _, t, q, _ in labelled(rng, 120)])
    texts = [b"", b"x", b"ab" * 40, *(words(rng, n).encode() for n in (3, 50, 400))] + [("abc " * 9 + words(rng, 30) + " é#").encode() * 3]
    want = [slow_probability(net, t) for t in texts]
    for size in (1 << 18, 128, 64):
        monkeypatch.setattr(quality, "BLOCK", size)
        got = np.concatenate([quality.probabilities(net, texts[a:b]) for a, b in quality.blocks(texts, size)])
        assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, which, docs, empty):
    made = labelled(random.Random(9), 700)
    d = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    train, score, mod, out = (quality.train_quality, quality.score_quality, 3, 1) if which == "quality" else (toxicity.train_toxicity, toxicity.score_toxicity, 5, 0)
    model = train(d, labels)
    truth = {i: (q if which == "quality" else x) for i, _, q, x in made}
    got = {r["doc_id"]: r["score"] for r in score(d, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % mod == out]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    odd = score(docs.unionByName(docs.limit(3)), model)
    assert odd.columns == ["doc_id", "score"] and odd.count() == docs.count() + 3 and odd.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    keep = quality.keep_quality if which == "quality" else toxicity.drop_toxic
    assert keep(docs, model).columns == docs.columns and keep(empty, model).count() == 0 and score(empty, model).count() == 0
    assert {r["doc_id"] for r in keep(d, model).collect()} == {i for i, s in got.items() if (s >= 0.5) == (which == "quality")}
    nothing = train(empty, labels.limit(0))
    assert score(docs, nothing).count() == docs.count() and keep(docs, nothing).count() == docs.count()


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(0, 1, (6, 8))[rng.integers(0, 6, 900)] * 3 + rng.normal(0, 0.5, (900, 8)), np.ones((300, 8)))).astype("float32")
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [None] * 8, 1), (2400, [float("inf")] * 8, 1), (2500, [], 1), (2600, [1.0] * 3, 1), (0, x[0].tolist(), 1)]
    schema = "vec_id long, embedding array<float>, part int"
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows + bad, schema), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 1200, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(d)), d))[:10]
        assert sorted(found) == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for v, s in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda f: (f[1], f[0]))
        hit += len({v for v, _ in found.values()} & set(true.tolist()))
    assert hit / (10 * len(got)) >= 0.9
    assert [v for v, _ in (got[1000][k] for k in sorted(got[1000]))] == list(range(900, 910))
    few = ann.nearest(spark.createDataFrame(rows[:4], schema), F.col("vec_id") == 0)
    assert few.count() == 3
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("parts", [None, 64])
def test_neighbours_without_structure(spark, monkeypatch, parts):
    monkeypatch.setattr(ann, "SHARE", 256)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (2500, 24)).round(3)
    x[5] = x[700]
    got = {}
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.nearest(d, F.col("vec_id") % 100 == 0, parts=parts).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 2500, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(far)), far))[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == far[v] or abs(s - far[v]) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 250


@pytest.mark.parametrize("n", [200, 9])
def test_neighbours_are_as_many_as_there_are(spark, n):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(0, 100, (50, 8)), 4, axis=0)[:n] + rng.normal(0, 0.1, (n, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = ann.nearest(d, F.col("vec_id") % 5 == 0, probes=1).groupBy("query_id").count().collect()
    assert {(r["query_id"], r["count"]) for r in counts} == {(i, min(10, n - 1)) for i in range(0, n, 5)}


def test_closest_is_exact_and_breaks_ties_by_id():
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (400, 3)) * 1e3 + 1e6
    ids = rng.permutation(400)
    q, at, score = ann.closest(x, ids, x[:20], ids[:20], 10)
    for k in range(20):
        far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        far[k] = np.inf
        assert at[q == k].tolist() == np.lexsort((ids, far))[:10].tolist() and score[q == k].tolist() == np.sort(far)[:10].tolist()
