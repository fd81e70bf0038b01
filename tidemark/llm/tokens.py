"""Token ids of whole texts with a public byte-level BPE of the ``tokenizers`` library.

The vocabulary's pre-tokenizer never lets a piece run from a visible character into white
space, nor from a letter into a character that isn't one. So texts can be cut at such places
and the cuts encoded on their own. The cuts of a batch are found on its bytes with numpy
and made distinct by Arrow, without a Python object for each; only the distinct ones are looked up,
and those not met before go to the library. A cut that is one piece (letters after at most one blank)
goes to the library's BPE model, any other one to the whole tokenizer.

A worker remembers cuts of at most ``LONGEST`` bytes in two generations of ``KEPT``: when the newer
one is full it becomes the older one, and what is met again moves back. So its memory is bounded
and what texts keep repeating stays. Texts are handled in strips of about ``STRIP`` bytes, so
that a very long one takes no more than its ids.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT, LONGEST, STRIP = 300_000, 48, 4 << 20
#: Short cuts that go to the whole tokenizer in one call.
CALL = 256
SPACE, LETTER, ASCII = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.arange(256) < 128
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: No cut follows these: white space, what some call white space, and the lead bytes of white space beyond ASCII.
UNSURE = SPACE.copy()
UNSURE[28:32] = True
#: Characters up to here are letters in any version of the Unicode tables.
LATIN = "ɏ"


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if visible, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTES = dict(enumerate(byte_letters()))


#: Whether a cut may start at a byte, by the byte before (low half) and the byte itself, white space beyond ASCII aside.
PAIRS = (SPACE[:, None] & ~UNSURE[None] | LETTER[None] & (ASCII & ~LETTER)[:, None]).ravel()


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Whether a cut may start at each byte; the first three bytes are context only."""
    pair = raw[3:].astype(np.uint16)
    pair <<= 8
    pair |= raw[2:-1]
    may = PAIRS[pair]
    if raw.max(initial=0) >= 128:
        at = np.flatnonzero(may & (raw[2:-1] >= 128))
        third = raw[at]
        may[at[(raw[at + 1] == 0xC2) | (third >= 0xE1) & (third <= 0xE3)]] = False
    return may


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def direct(self, cuts: list[bytes]) -> list[bytes]:
        """Ids of each cut, as little-endian unsigned 32-bit bytes, by the library."""
        out: list[bytes] = [b""] * len(cuts)
        pieces, spelled, mixed = [], [], []
        for i, cut in enumerate(cuts):
            letters = cut[1:] if cut[0] == 32 else cut
            if letters.isalpha():  # of bytes: ASCII letters only
                pieces.append(i)
                spelled.append(cut.decode().replace(" ", BYTES[32]))
                continue
            text = letters.decode()
            if text.isalpha() and max(text) <= LATIN:
                pieces.append(i)
                spelled.append(cut.decode("latin-1").translate(BYTES))
            elif len(cut) <= LONGEST:
                mixed.append(i)
            else:
                out[i] = self.whole([cut])[0]
        flat: list[int] = []
        ends = [0]
        for x in spelled:
            flat += [t.id for t in self.model.tokenize(x)]
            ends.append(len(flat) * 4)
        ids = array("I", flat).tobytes()
        for i, x, y in zip(pieces, ends, ends[1:], strict=False):
            out[i] = ids[x:y]
        for lo in range(0, len(mixed), CALL):
            some = mixed[lo : lo + CALL]
            for i, x in zip(some, self.whole([cuts[i] for i in some]), strict=True):
                out[i] = x
        return out

    def whole(self, cuts: list[bytes]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast([c.decode() for c in cuts], add_special_tokens=False)]

    def lookup(self, cuts: list[bytes]) -> list[bytes]:
        """Ids of distinct cuts, remembered or by the library."""
        found = list(map(self.new.get, cuts))
        missed = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in missed:
            found[i] = self.old.get(cuts[i])
            if found[i] is None:
                fresh.append(i)
        for i, x in zip(fresh, self.direct([cuts[i] for i in fresh]), strict=True):
            found[i] = x
        for i in missed:
            if len(cuts[i]) <= LONGEST:
                if len(self.new) >= KEPT:
                    self.old, self.new = self.new, {}
                self.new[cuts[i]] = found[i]
        return found

    def strip(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cuts of ``raw`` that begin at ``starts``, and the number of ids before each."""
        edges = np.append(starts, len(raw)).astype(np.int32)
        cuts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        held, ends = cuts.dictionary.buffers()[2].to_pybytes(), np.frombuffer(cuts.dictionary.buffers()[1], np.int32)[: len(cuts.dictionary) + 1].tolist()
        found = self.lookup([held[a:b] for a, b in zip(ends, ends[1:], strict=False)])  # several times as fast as to_pylist
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = cuts.indices.to_numpy()
        n = sizes[code]
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        at = np.repeat((np.cumsum(sizes) - sizes)[code] - before[:-1], n) + np.arange(before[-1])
        return np.frombuffer(b"".join(found), dtype="<u4")[at], before

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (and the last one's end); a null text is empty."""
        texts = column.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        raw = np.concatenate((np.full(3, 32, np.uint8), data))
        whole = np.zeros(len(texts), dtype=bool)  # texts with a special token's string are one cut
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[bounds] = True
        parts, offsets, lo, held, size = [], np.zeros(len(bounds), np.int64), 0, 0, STRIP
        while lo < len(data):
            hi = min(len(data), lo + size)
            may = cut_places(raw[lo : hi + 3])
            for i in np.flatnonzero(whole & (bounds[:-1] < hi) & (bounds[1:] > lo)):
                may[max(0, bounds[i] - lo) : max(0, bounds[i + 1] - lo)] = False
            may |= first[lo:hi]
            may[0] = True
            starts = np.flatnonzero(may)
            if hi < len(data):
                if len(starts) == 1:
                    size *= 2  # no place to cut: a longer strip
                    continue
                hi, starts = lo + int(starts[-1]), starts[:-1]
            size = STRIP
            ids, before = self.strip(data[lo:hi], starts)
            inside = slice(*np.searchsorted(bounds, (lo, hi)))
            offsets[inside] = held + before[np.searchsorted(starts, bounds[inside] - lo)]
            parts.append(ids)
            held += len(ids)
            lo = hi
        offsets[np.searchsorted(bounds, len(data)) :] = held
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), offsets


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and path."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def ended(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end_id`` last, in one array, and where each text's begin (and the last one's end)."""
    ids, offsets = encoder(path).encode(column)
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
