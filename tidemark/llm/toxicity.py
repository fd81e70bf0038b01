"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text without punctuation, white space made one
space, hashed to ``BUCKETS``. Their lengths and limits were chosen by cross-validation on rows that may be learnt from. Each feature is scaled by its log-count ratio between toxic
and clean training texts, and a logistic regression is fitted on the scaled features.
The scaled features of a text are divided by their length as a vector; ratios near zero
are left out, so that the common n-grams of a long text don't dilute its evidence.

Null texts count as empty; an empty text gets the score of the intercept. Rows are scored
one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, labelled_sample, texts_of
from tidemark.llm.quality import blocks

ORDERS, BITS, ALPHA = (3, 4, 5, 6, 7), 20, 0.5
#: What is left out before n-grams are taken: neither letter, digit nor white space.
MARKS = re.compile(r"[^\w\s]|_")
BUCKETS = 1 << BITS
#: A feature is used from so many training texts, and from so large a log-count ratio.
LEAST_TEXTS, LEAST_RATIO = 8, 2.5
#: Rows that a model is fitted on at most.
SAMPLE_ROWS = 5000
STEPS, RATE, L2, GAP = 50, 0.1, 1e-5, 8


@dataclass
class NBLinear:
    theta: np.ndarray  # BUCKETS, weight times log-count ratio
    square: np.ndarray  # BUCKETS, log-count ratio squared; 0 where a feature is left out
    c: float


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces and ``GAP`` zeros behind, and where each starts."""
    clean = [f" {' '.join(MARKS.sub('', t.lower()).split())} " + "\0" * GAP for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in clean])))
    return np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place; 0 where it would run into a gap."""
    n = len(points) - order + 1
    h = np.zeros(n, dtype=np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) ^ points[k : k + n]
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D) + np.uint32(order)) >> np.uint32(32 - BITS)
    h[points[order - 1 :] == 0] = 0
    h[points[:n] == 0] = 0
    return h


def distinct(doc: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((doc << BITS) | feat)
    return keys >> BITS, keys & (BUCKETS - 1)


def features(text: str) -> np.ndarray:
    """The distinct buckets of one text."""
    points, _ = codes([text])
    h = np.concatenate([grams(points, order) for order in ORDERS])
    h = h[h != 0]
    place = np.zeros(BUCKETS, dtype=np.int32)
    at = np.arange(len(h), dtype=np.int32)
    place[h] = at
    return h[place[h] == at]


def fit(rows: list[tuple[str, int]]) -> NBLinear:
    """Log-count ratios, then a logistic regression on the scaled presence features.

    Features in fewer than ``LEAST_TEXTS`` texts, or with a ratio of less than ``LEAST_RATIO``
    either way, say little of either class and are left out.
    """
    y = np.array([v for _, v in rows], dtype=np.float64)
    none = NBLinear(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))))  # without labels a text is clean
    if len(set(y.tolist())) < 2:
        return none
    count = np.zeros((2, BUCKETS))
    each = [features(t) for t, _ in rows]
    for f, v in zip(each, y, strict=True):
        count[int(v), f] += 1
    ratio = np.log((count[1] + ALPHA) / (y.sum() + 2 * ALPHA)) - np.log((count[0] + ALPHA) / (len(y) - y.sum() + 2 * ALPHA))
    ratio[(count.sum(axis=0) < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    each = [f[ratio[f] != 0] for f in each]
    doc, feat = np.repeat(np.arange(len(each)), [len(f) for f in each]), np.concatenate(each)
    if not len(feat):
        return none
    ids, col = np.unique(feat, return_inverse=True)
    x = ratio[ids][col] / np.sqrt(1 + np.bincount(doc, weights=ratio[feat] ** 2, minlength=len(y)))[doc]
    w, c = np.zeros(len(ids) + 1), none.c
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = c
    for t in range(1, STEPS + 1):  # Adam on the log loss of all rows
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=x * w[col], minlength=len(y)) + w[-1], -30, 30)))
        g = np.append(np.bincount(col, weights=x * ((p - y) / len(y))[doc], minlength=len(ids)) + L2 * w[:-1], ((p - y) / len(y)).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    theta, square = none.theta.copy(), none.square.copy()
    theta[ids], square[ids] = w[:-1] * ratio[ids], ratio[ids] ** 2
    return NBLinear(theta, square, float(w[-1]))


def probabilities(model: NBLinear, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    points, starts = codes(texts)
    docs, feats = [], []
    for order in ORDERS:
        h = grams(points, order)
        at = np.flatnonzero(model.square[h])
        docs.append(np.searchsorted(starts, at, side="right") - 1)
        feats.append(h[at].astype(np.int64))
    doc, feat = distinct(np.concatenate(docs), np.concatenate(feats))
    z = np.bincount(doc, weights=model.theta[feat], minlength=len(texts)).astype(np.float64)
    z /= np.sqrt(1 + np.bincount(doc, weights=model.square[feat], minlength=len(texts)))
    return 1 / (1 + np.exp(-np.clip(z + model.c, -30, 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> NBLinear:
    """Fit on at most ``rows`` labelled texts outside the held-out fifth (crc32 of the id mod 5 is 0)."""
    return fit(labelled_sample(docs, labels, "toxic", crc_of_id() % 5 != 0, rows))


def score_toxicity(docs: DataFrame, model: NBLinear, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and its ``score`` from the whole text.

    The model has a fixed size (8 MB before compression), whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            p = [probabilities(shared.value, texts[a:b]) for a, b in blocks(texts)]
            score = pa.array(np.concatenate(p) if p else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return texts_of(docs, *keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: NBLinear, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``most``, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            p = [probabilities(shared.value, texts[a:b]) for a, b in blocks(texts)]
            yield batch.filter(pa.array(np.concatenate(p) < most)) if p else batch

    return texts_of(docs, *docs.columns).mapInArrow(run, docs.schema)
