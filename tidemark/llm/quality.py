"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each one a symbol of 512: the byte, plus 256 where the byte
lies in a stretch that repeats the bytes a few places before it. That bit is a feature made by hand, as
filters of this width can't compare bytes so far apart. Learned filters look at
overlapping chunks of ``2 * STEP`` bytes, one every ``STEP`` bytes, from the first byte to
the last; each filter keeps its largest response in the document, and the pooled responses
are combined into one probability. Scoring streams Arrow batches through ``mapInArrow``;
the model is a few ten kilobytes and travels in the closure.

Null texts count as empty; an empty text is one chunk of padding and so gets a score too.
Repeated rows are scored one by one, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, labelled_sample, texts_of

STEP, SIZE, FILTERS, PAD = 8, 6, 24, 32
#: Lags at which a stretch of bytes counts as repeated, and bytes in a stretch.
LAGS, RUN = range(2, 25), 8
#: Rows that a model is fitted on at most.
SAMPLE_ROWS = 4000
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Bytes scored at once, and bytes before a strip that tell what repeats in it.
BLOCK, CONTEXT = 1 << 18, 64


@dataclass
class ByteConvNet:
    emb: np.ndarray  # 512 x SIZE
    w: np.ndarray  # 2 * STEP * SIZE x FILTERS
    b: np.ndarray  # FILTERS
    v: np.ndarray  # FILTERS
    c: float


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in one array, and the first chunk of each text.

    Zero bytes stand between texts, so that no repeat spans two of them.
    """
    sizes = np.array([-(-len(t) // STEP) * STEP + PAD for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.zeros(starts[-1] + PAD, dtype=np.uint8)
    for t, at in zip(texts, starts, strict=False):
        raw[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
    rep = np.zeros(len(raw), dtype=bool)
    for lag in LAGS:
        eq = raw[lag:] == raw[:-lag]
        n = 1
        while n < RUN:
            eq = eq[:-n] & eq[n:]
            n *= 2
        rep[lag + RUN - 1 : lag + RUN - 1 + len(eq)] |= eq
    rep &= raw != 0
    return raw[: starts[-1] + STEP].astype(np.int16) + (rep[: starts[-1] + STEP].astype(np.int16) << 8), starts[:-1] // STEP


def chunks(net: ByteConvNet, codes: np.ndarray) -> np.ndarray:
    """Responses of the filters to each chunk."""
    e = net.emb[codes].reshape(-1, STEP * SIZE)
    half = STEP * SIZE
    return e[:-1] @ net.w[:half] + e[1:] @ net.w[half:]


def responses(net: ByteConvNet, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``chunks`` without those that would reach into the next text; all their own bytes are padding."""
    z = chunks(net, codes)
    z[first[1:] - 1] = -np.inf
    return z


def pooled(net: ByteConvNet, texts: list[bytes]) -> np.ndarray:
    """The largest response of each filter in each text; a text over ``BLOCK`` bytes in strips, with the maximum so far."""
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        text, top = texts[0], None
        for lo in range(0, len(text), BLOCK):
            before, after = min(lo, CONTEXT), len(text) - lo > BLOCK
            z = chunks(net, symbols([text[lo - before : lo + BLOCK + after * STEP]])[0])
            z = z[before // STEP : (before + BLOCK) // STEP if after else None].max(axis=0)
            top = z if top is None else np.maximum(top, z)
        return top[None]
    codes, first = symbols(texts)
    return np.maximum.reduceat(responses(net, codes, first), first, axis=0)


def probabilities(net: ByteConvNet, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    top = pooled(net, texts) + net.b
    return 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ net.v + net.c, -30, 30).astype(np.float64)))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> ByteConvNet:
    """Adam on the log loss; gradients reach the chunk that gave each filter's maximum."""
    rng = np.random.default_rng(seed)
    half = STEP * SIZE
    net = ByteConvNet(
        rng.normal(0, 0.5, (512, SIZE)).astype(np.float32), rng.normal(0, 1 / np.sqrt(2 * half), (2 * half, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0,
    )
    y_all = np.array([y for _, y in rows], dtype=np.float32)
    if len(set(y_all.tolist())) < 2:
        net.v[:] = 0
        net.c = float(np.log((y_all.sum() + 1) / (len(y_all) - y_all.sum() + 1)))
        return net
    data = [t.encode() for t, _ in rows]
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("emb", "w", "b", "v")} | {"c": (0.0, 0.0)}
    t = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            codes, first = symbols([data[i] for i in pick])
            z = responses(net, codes, first)
            last = np.append(first[1:], len(z))
            at = np.stack([a + z[a:e].argmax(axis=0) for a, e in zip(first, last, strict=True)])  # doc x filter
            top = np.take_along_axis(z, at, axis=0) + net.b
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.v + net.c, -30, 30)))
            d = ((p - y_all[pick]) / len(pick)).astype(np.float32)
            g = {"v": act.T @ d, "c": float(d.sum()), "emb": np.zeros_like(net.emb)}
            dz = d[:, None] * net.v * (top > 0)
            g["b"] = dz.sum(axis=0)
            seen = codes[at[:, :, None] * STEP + np.arange(2 * STEP)]  # doc x filter x byte
            x = net.emb[seen].reshape(*at.shape, -1)
            g["w"] = np.einsum("dkx,dk->xk", x, dz)
            np.add.at(g["emb"], seen, (dz[:, :, None] * net.w.T).reshape(*seen.shape, SIZE))
            t += 1
            for k, (m, s) in state.items():
                m = 0.9 * m + 0.1 * g[k]
                s = 0.999 * s + 0.001 * g[k] ** 2
                state[k] = (m, s)
                setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8))
    for k in ("emb", "w", "b", "v"):
        setattr(net, k, getattr(net, k).astype(np.float32))
    return net


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes each; a longer text stands alone, and is scored in strips."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteConvNet:
    """Fit on at most ``rows`` labelled texts outside the held-out third (crc32 of the id mod 3 is 1)."""
    return fit(labelled_sample(docs, labels, "quality", crc_of_id() % 3 != 1, rows))


def score_quality(docs: DataFrame, net: ByteConvNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and its ``score`` from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(batch.num_columns - 1))
            p = [probabilities(net, texts[a:b]) for a, b in blocks(texts)]
            score = pa.array(np.concatenate(p) if p else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return texts_of(docs, *keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, net: ByteConvNet, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            p = [probabilities(net, texts[a:b]) for a, b in blocks(texts)]
            yield batch.filter(pa.array(np.concatenate(p) >= least)) if p else batch

    return texts_of(docs, *docs.columns).mapInArrow(run, docs.schema)
