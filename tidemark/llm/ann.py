"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors is made a graph of exact neighbours, and the graph is cut into
parts of nearly equal size with few edges between them (recursive bisection, refined by balanced
swaps). The number of parts grows with the table, so that a part is of bounded size, up to
``MOST_PARTS``; the sample grows with the parts to 65,536 vectors at most. A small classifier learns which part the neighbours of a vector lie in. It names the
part of every row, and routes each query to its most probable parts, where the query meets the
rows for exact distances in double precision. The model is fitted once and is of fixed size;
every row is indexed.

Rows are dealt by part and by a hash of vec_id, into shares of about ``SHARE`` rows; queries go to
all shares of their parts, in blocks of about ``SHARE`` queries. Of rows with equal vectors only the
``k`` + 1 of smallest vec_id can be among a query's nearest (one may be the query itself), so copies of
one vector are reduced to these before they meet the queries; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Vectors that the index is fitted on: so many, more if there are so many for each part; neighbours of each in their graph.
SAMPLE, SAMPLE_PER_PART, NEIGHBOURS = 4096, 64, 16
#: Fewest and most parts, and distinct vectors for each; rows of a share of a part.
PARTS, MOST_PARTS, PART_ROWS, SHARE = 16, 1024, 4096, 4096
K, SEED = 10, 5
#: Share of the neighbours of held-out sample vectors that the probed parts must hold; one vector in so many is held out.
TARGET, HELD = 0.95, 8
HIDDEN, EPOCHS, BATCH, RATE = 64, 40, 128, 0.01
#: Queries whose distances are taken at once.
QUERIES = 256
#: Components beyond this are scaled before they are squared.
LARGE = 1e100


@dataclass
class Router:
    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    unit: float = 1.0  # what components are divided by first

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x / self.unit, -LARGE, LARGE)
        return np.maximum((x - self.mean) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def unit_of(x: np.ndarray) -> float:
    """One, or a power of two about the largest magnitude if its square would be too large."""
    top = np.abs(x).max(initial=0.0)
    return 2.0 ** int(np.log2(top)) if top > LARGE else 1.0


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for lo in range(0, len(x), 512):
        d = square[lo : lo + 512, None] - 2 * x[lo : lo + 512] @ x.T + square
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def bisect(nodes: np.ndarray, near: np.ndarray, x: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes``: along the main axis, then swaps of the nodes that gain most edges."""
    y = x[nodes] - x[nodes].mean(axis=0)
    axis = np.linalg.svd(y[:2000], full_matrices=False)[2][0]
    side = np.zeros(len(nodes), dtype=bool)
    side[np.argsort(y @ axis, kind="stable")[len(nodes) // 2 :]] = True
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    links = place[near[nodes]]
    inside = links >= 0
    a, b = np.repeat(np.arange(len(nodes)), inside.sum(axis=1)), links[inside]
    for _ in range(rounds):
        cross = (side[a] != side[b]) * 2.0 - 1
        gain = np.bincount(a, cross, len(nodes)) + np.bincount(b, cross, len(nodes))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        swap = np.flatnonzero(gain[left[:n]] + gain[right[:n]] > 0)[: max(1, n // 8)]
        if not len(swap):
            break
        side[left[swap]], side[right[swap]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row: halves of halves, so that sizes differ by rounding only."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [h for g in groups for h in (bisect(g, near, x) if len(g) > 1 else (g, g[:0]))]
    out = np.zeros(len(x), dtype=np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


def fit(x: np.ndarray, parts: int = PARTS, seed: int = SEED) -> Router:
    """Partition the neighbour graph of ``x`` and learn in which parts a row and its neighbours lie.

    Held-out vectors tell how many parts must be probed for ``TARGET`` of the neighbours.
    """
    unit = unit_of(x)
    x = x / unit
    whole, x = x, x[len(x) // HELD :]
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = float(np.sqrt(((x - mean) ** 2).sum(axis=1).mean())) if len(x) else 1.0
    r = Router(mean, rng.normal(0, 1, (x.shape[1], HIDDEN)) / (scale or 1.0), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts), parts, unit)
    if len(x) < 2 * parts:
        return r
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    target = 0.5 * target + 0.5 * np.eye(parts)[part]
    y = (x - mean) / (scale or 1.0)
    r.w1 *= scale or 1.0
    names = ("w1", "b1", "w2", "b2")
    moments = {k: (np.zeros_like(getattr(r, k)), np.zeros_like(getattr(r, k))) for k in names}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            h = np.maximum(y[i] @ r.w1 + r.b1, 0)
            z = h @ r.w2 + r.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
            dh = dz @ r.w2.T * (h > 0)
            t += 1
            for k, g in zip(names, (y[i].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)), strict=True):
                m, v = moments[k]
                moments[k] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                step = RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                setattr(r, k, getattr(r, k) - step)
    r.w1 /= scale or 1.0
    score = r.scores(whole * unit)
    lies = score.argmax(axis=1)[neighbour_graph(whole, K)[: len(whole) // HELD]]
    rank = np.argsort(np.argsort(-score[: len(lies)], axis=1, kind="stable"), axis=1)
    reached = np.bincount(np.take_along_axis(rank, lies, axis=1).ravel(), minlength=parts).cumsum() / max(1, lies.size)
    r.probes = int(np.searchsorted(reached, TARGET - 1e-12)) + 1
    return r


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, all components finite, and not all zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(rows: DataFrame, queries: Column, k: int = K, parts: int | None = None, probes: int | None = None, sample: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest of each row that ``queries`` picks.

    ``rows`` has vec_id and embedding. Vectors that aren't ``usable`` or don't have the commonest
    length take no part. Ties go to the smaller vec_id; extra columns are ignored; an empty table gives
    no rows. Rows of one vec_id are one row. ``probes`` is the number of parts each query is routed to,
    by default what the fitted index needs for ``TARGET``; a query goes on to further parts until they hold
    ``k`` rows besides its own, so that it gets ``k`` neighbours, or all candidates if there are fewer.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    known = rows.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sizes = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    known = known.where(F.size("v") == sizes[0]["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    # copies: (vector, part of its rows) keeps its k + 1 smallest ids, then the vector does
    copies = known.withColumn("h", F.xxhash64("v"))
    first = copies.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["h", "v", "_salt"], ["h", "v"]):
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    first = cut(first, "vectors")
    if parts is None:
        distinct = first.where("_n = 1").count()
        parts = min(MOST_PARTS, max(PARTS, 1 << (-(-distinct // PART_ROWS) - 1).bit_length()))
    sample = sample or max(SAMPLE, SAMPLE_PER_PART * parts)
    picked = [np.array(r["v"]) for r in first.where("_n = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    shared = spark.sparkContext.broadcast(fit(np.array(picked), parts))

    def route(batches: Iterator[pd.DataFrame], most: int, held: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                top = np.argsort(-shared.value.scores(stacked(b["v"])), axis=1, kind="stable")
                short = np.cumsum(held[top], axis=1) - held[top] <= k  # the parts before hold too few rows
                for j in range(top.shape[1]):
                    to = np.flatnonzero(short[:, j] | (j < most))
                    if len(to):
                        yield b.iloc[to].assign(part=top[to, j].astype(np.int32))

    schema = "vec_id long, v array<double>, part int"
    placed = cut(first.select("vec_id", "v").mapInPandas(lambda it: route(it, 1, np.full(parts, k + 1)), schema), "placed")
    held = np.zeros(parts, dtype=np.int64)
    for r in placed.groupBy("part").count().collect():  # one row a part
        held[r["part"]] = r["count"]
    asked = cut(known.where(queries).mapInPandas(lambda it: route(it, probes or shared.value.probes, held), schema), "asked")
    # one row a part: how many shares its rows and its queries are dealt to
    shares = placed.groupBy("part").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("blocks"))
    plan = F.broadcast(shares.join(blocks, "part"))
    left = placed.join(plan, "part").select("part", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    right = asked.join(plan, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.col("vec_id").alias("query_id"), "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(a) and len(b):
            x, ids, y, own = stacked(a["v"]), a["vec_id"].to_numpy(), stacked(b["v"]), b["query_id"].to_numpy()
            for lo in range(0, len(y), QUERIES):
                q, at, score = closest(x, ids, y[lo : lo + QUERIES], own[lo : lo + QUERIES], k)
                found.append(pd.DataFrame({"query_id": own[lo + q], "vec_id": ids[at], "score": score}))
        return pd.concat(found[1:] or found)

    met = left.groupBy("part", "share", "block").cogroup(right.groupBy("part", "share", "block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def closest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of the ``k`` rows of ``x`` nearest to each of ``y``, but for its own; ties to the smaller id.

    Candidates come from one matrix product, with room for its rounding; their distances are taken exactly. Components too large to be squared are divided by a power of two.
    """
    unit = max(unit_of(x), unit_of(y))
    x, y = (x / unit, y / unit) if unit > 1 else (x, y)
    square = (x * x).sum(axis=1)
    d = square - 2 * (y @ x.T)  # but for the query's own square
    d[own[:, None] == ids] = np.inf
    edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    room = 1e-9 * (square.max() + (y * y).sum(axis=1))
    q, at = np.nonzero((d <= (edge + room)[:, None]) & np.isfinite(d))
    score = np.sqrt(((x[at] - y[q]) ** 2).sum(axis=1))
    order = np.lexsort((ids[at], score, q))
    q, at, score = q[order], at[order], score[order] * unit
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], at[best], score[best]
