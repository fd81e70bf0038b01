"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit check.

Texts are lower-cased, and ASCII punctuation and white space become one blank. The CGK embedding
walks over the bytes of a window: step j writes the byte at the walker, and a random bit of
(j, byte) says whether it moves on. Two windows at a small edit distance keep walking together or
fall into step again, so their embeddings differ in few places. A repetition samples places of
the embedding; where all of them agree, the windows share a signature. The embedding at a start
doesn't depend on the window's end, so one walk from every ``STRIDE``-th byte of a document serves the windows of all items,
and an item is embedded from each of its own bytes: each start within it is one more repetition, with an alignment known.

Agreeing signatures are counted by item and alignment (place in the document less place in the item, in
bins that hold the drift of all edits allowed). A window of an item's size becomes a candidate from the
item's threshold on. Thresholds come from ``RECALL``: for each class of length, copies of every item with
the edits allowed, at random places and one to a word, are embedded in tasks, and all but a share of 1 - ``RECALL`` of the
worse of the two must reach the threshold; only counts by class reach the driver. An item uses the first of ``SHAPES``, the most selective first, for which
that is at least one, or else the last. Candidates are verified by exact edit distance (Myers' bit vectors over the
bytes), after those are left out whose parts alone are too far away.

An item under ``LEAST_BYTES`` bytes is too short to tell an edited copy from chance: it is looked up
verbatim, by the hash of its words, at word borders. Items without any letter or digit, and null and empty texts, match
nothing. Items are looked up from a broadcast table of about ``PART_BYTES`` of item text; a larger benchmark takes several
passes. Documents are never shuffled. Texts over ``BLOCK`` bytes are searched in strips that overlap by more than the longest window.

Repeated rows are searched one by one, null ids are ids like any other, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of

#: Least similarity, 1 - distance / bytes of the item.
SIMILARITY = 0.8
#: (steps of a walk, places sampled, walks), from the most selective on.
SHAPES = ((24, 8, 3), (16, 8, 3), (12, 6, 3), (9, 4, 3))
#: Share of the copies at the least similarity that must become candidates; copies simulated of an item, growth of classes.
RECALL, TRIALS, CLASS = 0.98, 60, 1.2
#: Bytes of copies simulated at once.
COPIES = 1 << 20
LEAST_BYTES, PART_BYTES, SEED = 20, 4 << 20, 11
#: Walks start at every so many bytes of a document.
STRIDE = 3
#: Bytes of a cell of an item: neighbouring signatures often agree together and count once.
CELL = 8
#: Bytes of an item's parts, one machine word each.
PART = 64
#: Bytes of a block, of the blocks whose candidates are verified together, and windows verified at once.
BLOCK, HELD, BATCH = 1 << 17, 8 << 20, 4_096
#: Windows, by machine word of the pattern, up to which a step of Python's integers costs less than one of arrays.
FEW = 60
BLANKS = bytes(32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


POWERS: dict[str, np.ndarray] = {"up": powers(BASE, BLOCK * 2), "down": powers(INVERSE, BLOCK * 2)}


def clean(text: str) -> bytes:
    """Lower-cased bytes with blanks for punctuation; as long as the text's own bytes, for offsets.

    A letter whose lower case has another length in bytes stays as it is.
    """
    low = text.lower()
    if not text.isascii():
        low = low.replace("ς", "σ")  # which of the two it is depends on the letters around
        if len(low.encode("utf-8", "replace")) != len(text.encode("utf-8", "replace")):
            same = {c: c.lower() for c in set(text) if len(c.lower().encode("utf-8", "replace")) == len(c.encode("utf-8", "replace"))}
            low = text.translate(str.maketrans(same)).replace("ς", "σ")
    return low.encode("utf-8", "replace").translate(BLANKS)


def borders(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    full = np.concatenate(([False], flat != 32, [False]))
    edge = np.flatnonzero(full[1:] != full[:-1])
    return edge[::2], edge[1::2]


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch from ``start`` to ``end``, by sums of scaled bytes."""
    n = len(flat)
    if n > len(POWERS["up"]):
        POWERS.update(up=powers(BASE, n), down=powers(INVERSE, n))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * POWERS["up"][:n])))
    h = (total[end] - total[start]) * POWERS["down"][start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Walk:
    words: np.ndarray  # of each byte: the byte in the upper 8 bits, and in bit j whether the walker moves on at step j
    places: list[int]  # sampled steps, ascending


def walks(shape: tuple[int, int, int]) -> list[Walk]:
    steps, sampled, count = shape
    rng = np.random.default_rng(SEED + steps)
    made = []
    for _ in range(count):
        moves = (rng.random((steps, 256)) < 0.5).astype(np.uint32)  # 24 steps at most
        words = (moves << np.arange(steps, dtype=np.uint32)[:, None]).sum(axis=0, dtype=np.uint32) | np.arange(256, dtype=np.uint32) << np.uint32(24)
        made.append(Walk(words, sorted(set(((np.arange(sampled) + rng.random(sampled)) * steps // sampled).astype(int).tolist()))))
    return made


WALKS = [walks(shape) for shape in SHAPES]


def signatures(raw: np.ndarray, walk: Walk, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The sampled bytes of the walk from every ``step``-th byte of ``raw``, hashed one to one, and the last byte sampled."""
    last = walk.places[-1]
    words = np.take(walk.words, np.concatenate((raw, np.zeros(last + 1, np.uint8))))
    at = np.arange(0, len(raw), step)
    held, byte = np.empty(len(at), np.uint32), np.empty(len(at), np.uint32)
    high, low = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)  # the bytes sampled, the last four in ``low``
    for j in range(last + 1):
        np.take(words, at, out=held, mode="clip")
        if j in walk.places:
            half = low if j in walk.places[-4:] else high
            half <<= np.uint32(8)
            half |= np.right_shift(held, np.uint32(24), out=byte)
        if j < last:
            held >>= np.uint32(j)
            held &= np.uint32(1)
            at += held
    sig = high.astype(np.uint64) << np.uint64(32) | low
    return sig * np.uint64(BASE), at


def copies(text: np.ndarray, edits: int, rng: np.random.Generator, trials: int) -> np.ndarray:
    """``trials`` rows with edits at random places, and as many with one edit in each word before all others."""
    start, end = borders(text)
    out = np.tile(text, (2 * trials, 1))
    order = rng.random(out.shape)
    place = start + (rng.random((trials, len(start))) * (end - start)).astype(np.int64)
    first = order[trials:]
    np.put_along_axis(first, place, np.take_along_axis(first, place, 1) - 1, 1)
    if edits:
        at = np.argpartition(order, edits - 1, 1)[:, :edits]
        np.put_along_axis(out, at, rng.integers(97, 123, at.shape, dtype=np.uint8), 1)
    return out


def kept_signatures(text: bytes, edits: int, shape: int) -> np.ndarray:
    """In how many cells of the item each simulated copy shares a signature with it at its own place: 2 x ``TRIALS``. The draws depend on the text alone."""
    raw = np.frombuffer(text, dtype=np.uint8)
    rng = np.random.default_rng([SEED, shape, zlib.crc32(text)])
    cells = np.arange(0, len(raw), CELL)
    own = [signatures(raw, walk) for walk in WALKS[shape]]
    step = max(1, COPIES // (2 * len(raw)))
    parts = []
    for lo in range(0, TRIALS, step):
        made = copies(raw, edits, rng, min(step, TRIALS - lo))
        padded = np.concatenate((made, np.zeros((len(made), 1), np.uint8)), axis=1)  # walks of a copy don't reach the next
        n = np.zeros(len(made), np.int64)
        for walk, (sig, end) in zip(WALKS[shape], own, strict=True):
            met = signatures(padded.ravel(), walk)[0].reshape(padded.shape)[:, :-1]
            n += np.logical_or.reduceat((met == sig) & (end < len(raw)) & (np.arange(len(raw)) % STRIDE == 0), cells, axis=1).sum(axis=1)
        parts.append(n.reshape(2, -1))
    return np.concatenate(parts, axis=1)


def words_of(text: str) -> bytes:
    return b" ".join(clean(text).split())


def allowed(size: int, similarity: float) -> int:
    """The edits of a copy of an item of ``size`` bytes."""
    return 0 if size < LEAST_BYTES else int((1 - similarity) * size + 1e-9)


def length_class(size: int) -> int:
    return int(np.log(size) / np.log(CLASS))


#: How many simulated copies of a class of length and kind of edits share how many signatures: class, kind, shared -> copies.
Tally = Mapping[tuple[int, int, int], int]


def tally(texts: Iterable[tuple[bytes, int]], similarity: float, shape: int, classes: set[int] | None) -> Tally:
    """The tally of the texts, each with its number, in ``classes`` (all, if none are given); texts under ``LEAST_BYTES`` have none."""
    out: Counter = Counter()
    for text, times in texts:
        group = length_class(len(text)) if len(text) >= LEAST_BYTES else None
        if group is None or classes is not None and group not in classes:
            continue
        for kind, n in enumerate(kept_signatures(text, allowed(len(text), similarity), shape).tolist()):
            for shared, copied in Counter(n).items():
                out[group, kind, shared] += copied * times
    return out


def shapes_and_thresholds(tallied: Callable[[int, set[int] | None], Tally]) -> dict[int, tuple[int, int]]:
    """The shape of the signatures of each class of length, and how many of them a candidate must share, from the tallies of all its items by shape."""
    made: dict[int, tuple[int, int]] = {}
    open_classes: set[int] | None = None
    for k in range(len(SHAPES)):
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for (group, kind, shared), n in tallied(k, open_classes).items():
            counts.setdefault((group, kind), {})[shared] = n
        open_classes = set()
        for group in sorted({g for g, _ in counts}):
            enough = min(lower_quantile(counts[group, kind], 1 - RECALL) for kind in (0, 1))
            if enough >= 1 or k + 1 == len(SHAPES):
                made[group] = k, max(1, enough)
            else:
                open_classes.add(group)
        if not open_classes:
            break
    return made


def lower_quantile(counts: dict[int, int], share: float) -> int:
    """The exact quantile of the values that ``counts`` counts, the lower one of two."""
    values = sorted(counts)
    upto = np.cumsum([counts[v] for v in values])
    return values[int(np.searchsorted(upto, int(share * (int(upto[-1]) - 1)), side="right"))]


@dataclass
class Seeds:
    walk: Walk
    shape: int
    start: np.ndarray  # of the entries by the top 20 bits of a signature
    some: np.ndarray  # whether there are any
    hashes: np.ndarray  # sorted
    item: np.ndarray
    offset: np.ndarray


@dataclass
class Patterns:
    texts: list[bytes]
    masks: dict[int, dict[int, int]] = field(default_factory=dict)

    def mask(self, i: int) -> dict[int, int]:
        """The places of each byte as bits."""
        if i not in self.masks:
            made: dict[int, int] = {}
            for p, c in enumerate(self.texts[i]):
                made[c] = made.get(c, 0) | 1 << p
            self.masks[i] = made
        return self.masks[i]


@dataclass
class Items:
    ids: list[int | None]
    texts: list[bytes]
    sizes: np.ndarray
    counts: np.ndarray  # words
    seeds: list[Seeds]
    least: np.ndarray  # shared signatures of a candidate
    edits: np.ndarray  # allowed; a bin of alignments is one wider
    short: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # number of words -> hashes (sorted) and items of the verbatim ones
    whole: Patterns
    parts: Patterns  # stretches of ``PART`` bytes
    first_part: np.ndarray


def index_items(rows: list[tuple[int | None, str]], similarity: float = SIMILARITY, chosen_by_class: dict[int, tuple[int, int]] | None = None) -> Items:
    """Signatures of the items at each of their bytes, for walks that stay within the item.

    Shapes and thresholds are those of ``chosen_by_class``, or come from these rows.
    """
    known = [(i, words_of(t)) for i, t in rows]
    known = [(i, t) for i, t in known if t]
    texts = [t for _, t in known]
    size = np.array([len(t) for t in texts], np.int64)
    edits = np.array([allowed(n, similarity) for n in size.tolist()], np.int64)
    long = np.flatnonzero(size >= LEAST_BYTES)
    shape, least = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
    if chosen_by_class is None:
        chosen_by_class = shapes_and_thresholds(lambda k, classes: tally(((t, 1) for t in texts), similarity, k, classes))
    for i in long.tolist():
        shape[i], least[i] = chosen_by_class[length_class(len(texts[i]))]
    seeds = []
    for k in range(len(SHAPES)):
        chosen = long[shape[long] == k].tolist()
        for walk in WALKS[k] if chosen else []:
            parts = []
            for i in chosen:
                sig, end = signatures(np.frombuffer(texts[i], dtype=np.uint8), walk)
                inside = np.flatnonzero(end < size[i])
                parts.append((sig[inside], np.full(len(inside), i, np.int32), inside.astype(np.int32)))
            flat, item, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(flat, kind="stable")
            start = np.searchsorted(flat[order] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
            seeds.append(Seeds(walk, k, start, start[1:] > start[:-1], flat[order], item[order], offset[order]))
    counts = np.zeros(len(texts), np.int64)
    short: dict[int, list] = {}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, dtype=np.uint8)
        counts[i] = t.count(b" ") + 1
        if len(t) < LEAST_BYTES:
            short.setdefault(int(counts[i]), []).append((int(word_hashes(raw, np.array([0]), np.array([len(t)]))[0]), i))
    table = {n: [(np.array([h for h, _ in x], np.uint64), np.array([i for _, i in x], np.int64))] for n, x in ((n, sorted(x)) for n, x in short.items())}
    cut = [[t[a : a + PART] for a in range(0, len(t), PART)] for t in texts]
    first = np.cumsum([0, *[len(c) for c in cut]])[:-1]
    return Items([i for i, _ in known], texts, size, counts, seeds, least, edits, table, Patterns(texts), Patterns([x for c in cut for x in c]), first)


def nearest_one(mask: dict[int, int], size: int, window: bytes) -> tuple[int, int]:
    """``nearest`` for one pattern of ``size`` bytes, on Python's integers."""
    full, last = (1 << size) - 1, 1 << size - 1
    plus, minus, score, least, end = full, 0, size, size, 0
    for j, c in enumerate(window, 1):
        eq = mask.get(c, 0)
        xv = eq | minus
        d = ((eq & plus) + plus ^ plus) | eq
        hp, hm = minus | full & ~(d | plus), plus & d
        if hp & last:
            score += 1
        elif hm & last:
            score -= 1
            if score < least:
                least, end = score, j
        hp <<= 1
        plus, minus = (hm << 1 | ~(xv | hp)) & full, hp & xv & full
    return least, end


def nearest(patterns: Patterns, item: np.ndarray, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to any stretch of its window, and where that stretch ends.

    Patterns of as many machine words are handled together, one place of all their windows a step; few windows one by one.
    """
    best, stop = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    sizes = np.array([len(patterns.texts[i]) for i in item.tolist()], np.int64)
    lengths = np.array([len(x) for x in windows], np.int64)
    one, top = np.uint64(1), np.uint64(63)
    order = np.lexsort((lengths, (sizes + 63) // 64))
    for part in np.split(order, np.flatnonzero(np.diff((sizes[order] + 63) // 64)) + 1):
        for lo in range(0, len(part), BATCH):
            at = part[lo : lo + BATCH]
            n, width = len(at), int(sizes[at[0]] + 63) // 64
            if lengths[at].sum() < FEW * width * lengths[at].max():
                for x in at.tolist():
                    best[x], stop[x] = nearest_one(patterns.mask(int(item[x])), int(sizes[x]), windows[x].tobytes())
                continue
            text = np.zeros((n, lengths[at].max()), np.uint8)  # no pattern has a zero byte
            for k, x in enumerate(at.tolist()):
                text[k, : lengths[x]] = windows[x]
            text = np.ascontiguousarray(text.T)
            which, own = np.unique(item[at], return_inverse=True)
            # patterns end at the top bit; the bits below a pattern match any byte at no cost
            table, plus = np.zeros((width, len(which) * 256), np.uint64), np.full((width, n), ~np.uint64(0))
            below = (-sizes[at] % 64).astype(np.uint64)
            plus[0] <<= below
            for k, i in enumerate(which.tolist()):
                lead = -len(patterns.texts[i]) % 64
                table[0, k * 256 : k * 256 + 256] = (1 << lead) - 1
                for c, mask in patterns.mask(i).items():
                    table[:, k * 256 + c] |= np.frombuffer((mask << lead).to_bytes(width * 8, "little"), np.uint64)
            minus = np.zeros((width, n), np.uint64)
            row = own.reshape(-1) * 256
            score = sizes[at].copy()
            least, end = score.copy(), np.zeros(n, np.int64)
            spot, better, sign = np.empty(n, np.int64), np.empty(n, bool), np.empty(n, np.int64)
            eq, xv, d, hp, hm, up, down, rise, fall = np.empty((9, n), np.uint64)
            for j in range(len(text)):
                np.add(row, text[j], out=spot)
                for w, (p, m) in enumerate(zip(plus, minus, strict=True)):
                    np.take(table[w], spot, out=eq, mode="clip")
                    np.bitwise_or(eq, m, out=xv)
                    if w:
                        eq |= down
                    np.bitwise_and(eq, p, out=d)
                    d += p
                    d ^= p
                    d |= eq
                    np.bitwise_or(d, p, out=hp)
                    np.invert(hp, out=hp)
                    hp |= m
                    np.bitwise_and(p, d, out=hm)
                    if w + 1 < width:
                        np.right_shift(hp, top, out=rise)
                        np.right_shift(hm, top, out=fall)
                    else:
                        score -= np.right_shift(hp.view(np.int64), 63, out=sign)
                        score += np.right_shift(hm.view(np.int64), 63, out=sign)
                    hp <<= one
                    hm <<= one
                    if w:  # carried from the word before
                        hp |= up
                        hm |= down
                    up, down, rise, fall = rise, fall, up, down
                    np.bitwise_and(hp, xv, out=m)
                    xv |= hp
                    np.invert(xv, out=xv)
                    np.bitwise_or(hm, xv, out=p)
                np.less(score, least, out=better)
                if better.any():
                    np.minimum(score, least, out=least)
                    end[better] = j + 1
            best[at], stop[at] = least, end
    return best, stop


def possible(items: Items, item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Which windows may be near enough: the least distances of an item's parts add up to no more than its own."""
    total, left = np.zeros(len(item), np.int64), np.arange(len(item))
    slack = np.array([len(w) for w in windows], np.int64) - items.sizes[item]
    for j in range(-(-int(items.sizes[item].max(initial=0)) // PART)):
        at = left[items.sizes[item[left]] > j * PART]
        some = [windows[k][j * PART : (j + 1) * PART + max(0, s)] for k, s in zip(at.tolist(), slack[at].tolist(), strict=True)]
        total[at] += nearest(items.parts, items.first_part[item[at]] + j, some)[0]
        left = left[total[left] <= items.edits[item[left]]]
    return left


def with_next(bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The counts of sorted bins, each with that of the bin after it."""
    out = n.copy()
    out[:-1] += np.where(bins[1:] == bins[:-1] + 1, n[1:], 0)
    return out


def crowded(key: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which keys may lie in two neighbouring bins with at least ``least`` keys: by counts in hashed cells, never too few."""
    out = np.zeros(len(key), dtype=bool)
    for shift in (0, 1):
        cell = ((key + shift >> 1).view(np.uint64) * np.uint64(BASE) >> np.uint64(46)).view(np.int64)
        out |= np.take(np.bincount(cell, minlength=1 << 18), cell) >= least
    return out


def seeded(items: Items, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, item, first and last place of the windows that share enough signatures with the item."""
    count = max(1, len(items.ids))
    seg_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[::STRIDE]
    pad = int(items.sizes.max(initial=0))
    share = 1 / (items.edits + 1)  # of a bin
    parts = []
    for k in sorted({s.shape for s in items.seeds}):
        keys, held, places, diagonals = [], [], [], []
        tables = [x for x in items.seeds if x.shape == k]
        for s in tables:
            h = signatures(flat, s.walk, STRIDE)[0]
            slot = (h >> np.uint64(44)).view(np.int64)
            near = np.flatnonzero(np.take(s.some, slot))
            slot = np.take(slot, near)
            lo = np.take(s.start, slot)
            n = np.take(s.start, slot + 1) - lo
            place = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            at = np.repeat(near, n)
            same = np.flatnonzero(np.take(s.hashes, place) == np.take(h, at))
            place, at = np.take(place, same), np.take(at, same)
            item = np.take(s.item, place)
            far = STRIDE * at - np.take(s.offset, place)
            # half a place more, so that rounding never falls short of a whole bin
            keys.append((np.take(seg_of, at) * count + item) << 24 | ((far + (pad + 0.5)) * np.take(share, item)).astype(np.int64))
            held.append(item)
            places.append(place)
            diagonals.append(far)
        key, item, far = np.concatenate(keys), np.concatenate(held), np.concatenate(diagonals)
        likely = np.flatnonzero(crowded(key, np.take(items.least, item)))
        key, far = np.take(key, likely), np.take(far, likely)
        begins = np.cumsum([0, *map(len, places)])
        cuts = np.searchsorted(likely, begins)
        kept = [np.take(x, likely[lo:hi] - begin) for x, lo, hi, begin in zip(places, cuts[:-1], cuts[1:], begins[:-1], strict=True)]
        offset = np.concatenate([np.take(s.offset, x).astype(np.int64) // CELL * len(tables) + r for r, (s, x) in enumerate(zip(tables, kept, strict=True))])
        if not len(key):
            continue
        bins, own, n = np.unique(key, return_inverse=True, return_counts=True)
        enough = with_next(bins, n) >= items.least[(bins >> 24) % count]
        enough |= np.concatenate(([False], enough[:-1] & (bins[1:] == bins[:-1] + 1)))
        bins, rank = bins[enough], (np.cumsum(enough) - 1)[own]
        among = enough[own]
        top = (pad // CELL + 1) * len(WALKS[k])
        once = np.unique(rank[among] * top + offset[among])  # a cell of the item counts once
        n = np.bincount(once // top, minlength=len(bins))
        bins = bins[with_next(bins, n) >= items.least[(bins >> 24) % count]]
        if len(bins):
            edge = np.concatenate(([True], bins[1:] != bins[:-1] + 1))
            group = np.cumsum(edge) - 1
            rank = np.minimum(np.searchsorted(bins, key), len(bins) - 1)
            left = bins[rank] == key
            of, far = group[rank[left]], far[left]
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -(1 << 62))
            np.minimum.at(low, of, far)
            np.maximum.at(high, of, far)
            parts.append((bins[edge] >> 24, low, high))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    both, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    seg, item = both // count, both % count
    # a copy runs through one of its agreeing places and strays from its alignment by the edits at most
    return seg, item, np.maximum(low - items.edits[item], bounds[seg]), np.minimum(high + items.sizes[item] + items.edits[item], bounds[seg + 1])


def verbatim(items: Items, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first place and end of the short items, word by word."""
    out = [(np.zeros(0, np.int64),) * 3]
    for n, tables in items.short.items():
        if len(start) < n:
            continue
        a, b = start[: len(start) - n + 1], end[n - 1 :]
        few = np.flatnonzero(b - a < LEAST_BYTES)
        h = word_hashes(flat, a[few], b[few])
        for sig, item in tables:
            lo, hi = np.searchsorted(sig, h, "left"), np.searchsorted(sig, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                x, y = int(a[few[k]]), int(b[few[k]])
                own = flat[x:y].tobytes()
                same = [i for i in item[lo[k] : hi[k]].tolist() if items.texts[i] == own]
                out.append((np.array(same, np.int64), np.full(len(same), x), np.full(len(same), y)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Block:
    """Segments of texts with single blanks, a zero byte between two."""

    flat: np.ndarray
    own: np.ndarray  # places of the bytes in their texts
    bounds: np.ndarray  # where segments start, and the end
    doc: np.ndarray  # of each segment


def blocks(texts: list[str], overlap: int) -> Iterator[Block]:
    """Neighbouring texts together, of about ``BLOCK`` bytes; a longer text in strips."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = clean(t)
        if len(raw) > BLOCK:
            yield from strips(i, np.frombuffer(raw, dtype=np.uint8), overlap)
            continue
        held.append((i, raw))
        size += len(raw)
        if size >= BLOCK:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(rows: list[tuple[int, bytes]]) -> Block:
    begins = np.concatenate(([0], np.cumsum([len(r) + 3 for _, r in rows])))
    flat = np.frombuffer(b" \0 ".join(r for _, r in rows) + b" \0 ", dtype=np.uint8)
    place = np.flatnonzero((flat != 32) | np.concatenate(([True], flat[:-1] != 32)))
    bounds = np.searchsorted(place, begins)
    return Block(flat[place], place - begins[np.repeat(np.arange(len(rows)), np.diff(bounds))], bounds, np.array([i for i, _ in rows]))


def strips(doc: int, raw: np.ndarray, overlap: int) -> Iterator[Block]:
    flat, own = raw[:0], np.zeros(0, np.int64)
    for lo in range(0, len(raw), BLOCK):
        part = raw[lo : lo + BLOCK]
        keep = np.flatnonzero((part != 32) | np.concatenate(([lo == 0 or raw[lo - 1] != 32], part[:-1] != 32)))
        flat, own = np.concatenate((flat[max(0, len(flat) - overlap) :], part[keep])), np.concatenate((own[max(0, len(own) - overlap) :], keep + lo))
        yield Block(np.concatenate((flat, np.array([32, 0, 32], np.uint8))), np.concatenate((own, np.full(3, len(raw)))), np.array([0, len(flat) + 3]), np.array([doc]))


@dataclass
class Windows:
    """Candidates of a block: the flat bytes from ``first`` to ``stop`` are searched for the item."""

    block: Block
    segment: np.ndarray
    item: np.ndarray
    first: np.ndarray
    stop: np.ndarray


#: A document, an item, start and end in bytes of the text, the distance.
Found = tuple[int, int, int, int, int]


def verified(parts: list[Windows], items: Items) -> Iterator[Found]:
    """The candidates that are near enough, at word borders around the passage as long as the item."""
    item = np.concatenate([p.item for p in parts])
    windows = [p.block.flat[x:y] for p in parts for x, y in zip(p.first.tolist(), p.stop.tolist(), strict=True)]
    left = possible(items, item, windows)
    distance, stop = items.sizes[item].copy(), np.zeros(len(item), np.int64)
    distance[left], stop[left] = nearest(items.whole, item[left], [windows[k] for k in left.tolist()])
    at = 0
    for p in parts:
        n = len(p.item)
        far, ends = distance[at : at + n], stop[at : at + n]
        at += n
        near = np.flatnonzero(far <= items.edits[p.item]).tolist()
        start, end = borders(p.block.flat) if near else (None, None)
        for k in near:
            last = int(np.searchsorted(start, p.block.bounds[p.segment[k] + 1] - 2)) - 1  # the last word before the zero byte
            z = min(int(np.searchsorted(end, p.first[k] + ends[k])), last)
            v = min(z, max(int(np.searchsorted(end, p.first[k], side="right")), z - int(items.counts[p.item[k]]) + 1))
            yield int(p.block.doc[p.segment[k]]), int(p.item[k]), int(p.block.own[start[v]]), int(p.block.own[end[z] - 1]) + 1, int(far[k])


def found_in(texts: list[str], items: Items) -> Iterator[Found]:
    held: list[Windows] = []
    size = 0
    for block in blocks(texts, 3 * int(items.sizes.max(initial=0)) + 64) if items.ids else ():
        if items.short:
            start, end = borders(block.flat)
            for i, x, y in zip(*(v.tolist() for v in verbatim(items, block.flat, start, end)), strict=True):
                yield int(block.doc[np.searchsorted(block.bounds, x, "right") - 1]), i, int(block.own[x]), int(block.own[y - 1]) + 1, 0
        found = Windows(block, *seeded(items, block.flat, block.bounds))
        if len(found.item):
            held.append(found)
            size += len(block.flat)
        if size > HELD:
            yield from verified(held, items)
            held, size = [], 0
    if held:
        yield from verified(held, items)


def search(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, start, end, distance, similarity): the best place of each item in each text."""
    best: dict[tuple[int, int], Found] = {}
    for f in found_in(texts, items):
        if f[:2] not in best or best[f[:2]][4] > f[4]:
            best[f[:2]] = f
    out, raw = [], (-1, b"")
    for doc, item, a, b, distance in best.values():
        if raw[0] != doc:
            raw = (doc, texts[doc].encode("utf-8", "replace"))
        span = [len(raw[1][:k].decode("utf-8", "ignore")) for k in (a, b)]
        out.append((doc, item, *span, distance, 1 - distance / int(items.sizes[item])))
    return out


def item_thresholds(benchmark: DataFrame, similarity: float) -> dict[int, tuple[int, int]]:
    """``shapes_and_thresholds`` of all items: each is simulated in a task, equal ones once, and tallies are summed by class."""
    tasks = int(benchmark.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = benchmark.where(F.col("text").isNotNull()).repartition(tasks, "text").groupBy("text").agg(F.count("*").alias("n"))

    def tallied(k: int, classes: set[int] | None) -> Tally:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((words_of(t), n) for b in batches for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            found = [(*key, n) for key, n in tally(rows, similarity, k, classes).items()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["class", "kind", "shared", "n"])

        parts = texts_of(texts, "text", "n").mapInArrow(run, "class long, kind long, shared long, n long")
        return {(r[0], r[1], r[2]): r[3] for r in parts.groupBy("class", "kind", "shared").agg(F.sum("n")).collect()}

    return shapes_and_thresholds(tallied)


def indexes(benchmark: DataFrame, similarity: float) -> list:
    """Broadcast tables of the items, each of about ``PART_BYTES`` of their texts."""
    known = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    parts = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    chosen, made = item_thresholds(known, similarity), []
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        made.append(known.sparkSession.sparkContext.broadcast(index_items([tuple(r) for r in rows], similarity, chosen)))
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start, end, distance, similarity: each item found in each document.

    ``start`` and ``end`` are code points of the document's own text, at word borders around
    the passage as long as the item. The best place of an item in a document counts once.
    """
    ids = docs.select("doc_id")
    schema = ids.schema.add("item_id", "long").add("start", "integer").add("end", "integer").add("distance", "integer").add("similarity", "double")
    source = texts_of(docs.where("text IS NOT NULL"), "doc_id", "text")

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = search(batch.column(1).to_pylist(), shared.value)
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                cols[1] = [shared.value.ids[i] for i in cols[1]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=["doc_id", "item_id", "start", "end", "distance", "similarity"])

        return run

    return reduce(DataFrame.unionByName, [source.mapInArrow(finder(shared), schema) for shared in indexes(benchmark, similarity)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, row by row, whatever their doc_id."""
    at = docs.columns.index("text")

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clear = np.ones(batch.num_rows, dtype=bool)
                clear[[f[0] for f in search([t or "" for t in batch.column(at).to_pylist()], shared.value)]] = False
                yield batch.filter(pa.array(clear))

        return run

    for shared in indexes(benchmark, similarity):
        docs = texts_of(docs, *docs.columns).mapInArrow(keeper(shared), docs.schema)
    return docs
