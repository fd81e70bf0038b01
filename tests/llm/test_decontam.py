"""Decontamination against exact edit distances: kinds and amounts of edits, lengths, odd rows, long texts."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest

from tidemark.llm import decontam

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return " ".join(rng.choice(["ka", "mel", "tor", "isu", "ban", "ledi", "vor"]) + rng.choice(["na", "ti", "sol", "ra", "", "dem"]) for _ in range(n))


def flat(text):
    return b" ".join(decontam.clean(text or "").split())


def slow_distance(a, b):
    """Least edit distance of ``a`` to any stretch of ``b``."""
    row, text, at = np.zeros(len(b) + 1, np.int64), np.frombuffer(b, np.uint8), np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.append(i + 1, np.minimum(row[1:] + 1, row[:-1] + (text != x)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def allowed(item):
    size = len(flat(item))
    return 0 if size < decontam.LEAST_BYTES else int(0.2 * size + 1e-9)


def edited(rng, text, kind, share):
    x, w = list(text), text.split()
    if kind == "letters":
        for p in rng.sample(range(len(x)), max(1, int(share * len(x)))):
            x[p] = rng.choice(LETTERS)
        return "".join(x)
    if kind == "mixed":
        for p in sorted(rng.sample(range(len(x)), max(1, int(share * len(x)))), reverse=True):
            x[p : p + 1] = rng.choice(([], [x[p], rng.choice(LETTERS)], [rng.choice(LETTERS)]))
        return "".join(x)
    for i in sorted(rng.sample(range(len(w)), max(1, int(share * len(w)))), reverse=True):
        p = rng.randrange(len(w[i]))
        w[i : i + 1] = {"inserted": [w[i], rng.choice("aeiou")], "typos": [w[i][:p] + rng.choice(LETTERS) + w[i][p + 1 :]], "replaced": [words(rng, 1)]}[kind]
    return " ".join(w)


@pytest.mark.parametrize("kind, share", [("letters", 0.02), ("letters", 0.08), ("letters", 0.15), ("letters", 0.19), ("mixed", 0.1), ("mixed", 0.19), ("inserted", 0.4), ("inserted", 0.5), ("typos", 0.5), ("typos", 1), ("replaced", 0.15)])
def test_recall(kind, share):
    rng = random.Random(8)
    items = [(i, words(rng, n)) for i, n in enumerate([4, 5, 6, 7, 9, 12, 16, 24, 36, 60] * 12)]
    index, texts, meant = decontam.index_items(items), [], []
    for i, t in items:
        copy = edited(rng, t, kind, share)
        if len(flat(t)) >= decontam.LEAST_BYTES and slow_distance(flat(t), flat(copy)) <= allowed(t):
            texts.append(f"{words(rng, 40)} {copy} {words(rng, 40)}")
            meant.append(i)
    found = {(r[0], index.ids[r[1]]) for r in decontam.search(texts, index)}
    for low, high in ((0, 60), (60, 1000)):
        some = [k for k, i in enumerate(meant) if low <= len(items[i][1]) < high]
        assert len(some) > 5 and sum((k, meant[k]) in found for k in some) >= 0.9 * len(some)


def test_found_places_are_near_enough_and_distances_least():
    rng = random.Random(2)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 2, 3, 5, 8, 14, 25, 60])]
    index = decontam.index_items(items)
    texts = [f"{words(rng, 20)} {edited(rng, t, 'letters', 0.1)}. {words(rng, 20)}" for _, t in items for _ in range(5)] + [words(rng, 300)]
    for text, item, start, end, distance, similarity in decontam.search(texts, index):
        own = items[index.ids[item]][1]
        if allowed(own):
            assert distance == slow_distance(flat(own), flat(texts[text])) <= allowed(own)
        else:
            assert distance == 0 and flat(texts[text][start:end]) == flat(own)
        assert similarity == 1 - distance / len(flat(own))
        assert (start == 0 or not texts[text][start - 1].isalnum()) and (end == len(texts[text]) or not texts[text][end].isalnum())


def test_short_items_are_found_verbatim_at_word_borders():
    index = decontam.index_items([(1, "Yes!"), (2, "ka ti"), (3, "tor, sol mel"), (4, "漢字"), (None, "no one"), (6, "..."), (7, "")])
    texts = ["oh YES it is", "yesterday", "ka  ti", "ka tin", "x tor sol: mel", "これ 漢字 です", "No one", None or "", "ka", "yes"]
    assert {(r[0], index.ids[r[1]]) for r in decontam.search(texts, index)} == {(0, 1), (2, 2), (4, 3), (5, 4), (6, None), (9, 1)}


def test_lower_case_does_not_depend_on_other_letters():
    item = "Élan vital et CÀ ET LÀ, écoutez Σίσυφος maintenant"
    index = decontam.index_items([(1, item.lower())])
    assert [r[4] for r in decontam.search(["İ " * 3 + item.upper(), item.upper(), item], index)] == [0, 0, 0]


def test_long_texts_are_searched_whole(monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 12)) for i in range(40)] + [(90, "odd one out")]
    index = decontam.index_items(items)
    filler = "".join(rng.choice(LETTERS + "  ") for _ in range(200_000))
    text = "".join(filler[4000 * k : 4000 * k + 4000] + f" {t.replace(' ', '  ,' + ' ' * (k % 50))} " for k, (_, t) in enumerate(items))
    want = sorted(decontam.search([text], index))
    assert {index.ids[r[1]] for r in want} >= {i for i, _ in items}
    for size in (1000, 4097):
        monkeypatch.setattr(decontam, "BLOCK", size)
        assert sorted(decontam.search([text], index)) == want


def test_operator_on_odd_rows(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(14, 50))) for i in range(12)] + [(90, None), (91, ""), (92, "ka ti"), (None, words(rng, 20))]
    rows = []
    for i, t in items[:12]:
        rows += [(10 * i, f"{words(rng, 80)} {t.upper()}, {words(rng, 80)}"), (10 * i + 1, f"{words(rng, 30)} {edited(rng, t, 'letters', 0.1)} {words(rng, 30)}"), (10 * i + 2, words(rng, 150))]
    rows += [(500, None), (501, ""), (502, "... ka ti."), (502, "... ka ti."), (None, f"x {items[3][1]}"), (None, "clean"), (503, items[-1][1]), (0, "a clean row of a leaking row's id")]
    d = spark.createDataFrame([(*r, 1.0, "n") for r in rows], "doc_id long, text string, similarity double, item_id string")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    leaks = [k for k, (_, t) in enumerate(rows) if any(t and flat(x) and (slow_distance(flat(x), flat(t)) <= allowed(x) if allowed(x) else f" {flat(x).decode()} " in f" {flat(t).decode()} ") for _, x in items)]
    got = decontam.contaminated(d, bench)
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("start", "int"), ("end", "int"), ("distance", "int"), ("similarity", "double")]
    assert {r["doc_id"] for r in got.collect()} == {rows[k][0] for k in leaks}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(503, None), (502, 92), (None, 3)}
    left = decontam.decontaminate(d, bench)
    key = lambda r: str(tuple(r))
    assert left.columns == d.columns and sorted(map(tuple, left.collect()), key=key) == sorted(((*r, 1.0, "n") for k, r in enumerate(rows) if k not in leaks), key=key)
    assert decontam.contaminated(d.limit(0), bench).count() == 0 and decontam.contaminated(d, bench.limit(0)).count() == 0
    assert decontam.decontaminate(d, bench.limit(0)).count() == len(rows)


def test_thresholds_come_from_every_item(spark):
    rng = random.Random(3)
    one_size = lambda n: " ".join("".join(rng.choice(LETTERS) for _ in range(n)) for _ in range(200 // (n + 1)))
    # edits of one a word lie evenly in short words, and leave fewer signatures; only every second item has long ones
    items = [(i, one_size((39, 4)[i % 2])) for i in range(16)]
    index = decontam.index_items(items)
    texts = [f"{words(rng, 40)} {edited(rng, t, 'typos', 0.95)} {words(rng, 40)}" for i, t in items if i % 2 for _ in range(10)]
    found = {(r[0], index.ids[r[1]]) for r in decontam.search(texts, index)}
    assert sum((k, 2 * (k // 10) + 1) in found for k in range(len(texts))) >= 0.95 * len(texts)
    other = decontam.index_items(items[1:] + items[:1])
    assert set(index.least.tolist()) == set(other.least.tolist())
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "ka ti"), (None, items[1][1])], "item_id long, text string").repartition(3)
    many = decontam.item_thresholds(bench, decontam.SIMILARITY)
    assert many == decontam.shapes_and_thresholds(lambda k, c: decontam.tally(((flat(t), 1 + (i == 1)) for i, t in items), decontam.SIMILARITY, k, c))
    held = decontam.indexes(bench, decontam.SIMILARITY)[0].value
    assert {(many[decontam.length_class(len(t))][1]) for t in held.texts if len(t) >= decontam.LEAST_BYTES} == set(held.least[held.sizes >= decontam.LEAST_BYTES].tolist())


def test_copies_of_a_long_item_are_simulated_a_few_at_a_time(monkeypatch):
    item, rows = flat(words(random.Random(1), 400)), []
    made = decontam.copies
    monkeypatch.setattr(decontam, "COPIES", 20 * len(item))
    monkeypatch.setattr(decontam, "copies", lambda *a: rows.append(made(*a)) or rows[-1])
    assert decontam.kept_signatures(item, 100, 0).shape == (2, decontam.TRIALS)
    assert max(x.nbytes for x in rows) <= 20 * len(item) and sum(map(len, rows)) == 2 * decontam.TRIALS


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_distances_by_arrays_and_by_integers(monkeypatch, few):
    rng = random.Random(5)
    monkeypatch.setattr(decontam, "FEW", few)
    texts = [flat(words(rng, 60))[:n] for n in (1, 2, 20, 63, 64, 65, 127, 128, 129, 200)]
    windows = [flat(f"{words(rng, 3)} {edited(rng, t.decode(), kind, 0.2)} {words(rng, 8)}") for t in texts for kind in ("letters", "mixed")]
    windows += [b"", b"ka\0ka", *texts]
    item = np.repeat(np.arange(len(texts)), len(windows))
    best, stop = decontam.nearest(decontam.Patterns(texts), item, [np.frombuffer(w, np.uint8) for w in windows] * len(texts))
    for k, i in enumerate(item.tolist()):
        own, window = texts[i], windows[k % len(windows)]
        assert best[k] == slow_distance(own, window) == slow_distance(own, window[: stop[k]]), (own, window)
        assert stop[k] == 0 or slow_distance(own, window[: stop[k] - 1]) > best[k]


def test_few_windows_take_no_array_step_for_each_word():
    rng = random.Random(5)
    item, lines = flat(words(rng, 400)), 0
    window = np.frombuffer(flat(f"{words(rng, 9)} {edited(rng, item.decode(), 'letters', 0.1)}"), np.uint8)
    patterns = decontam.Patterns([item])
    patterns.mask(0)

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        best, _ = decontam.nearest(patterns, np.array([0]), [window])
    finally:
        sys.settrace(before)
    assert 0 < best[0] <= 0.1 * len(item) and lines < 30 * len(window)
