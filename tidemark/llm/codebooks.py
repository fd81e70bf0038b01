"""Vector codes: product codebooks refined by Yinyang Lloyd in exact integers.

A component x becomes the integer floor(256 * x). Vectors are cut into ``PARTS`` equal parts, and
each part has a codebook of ``ENTRIES`` entries. Each codebook's entries are clustered into ``GROUPS`` groups once. A
row carries, for each part, its entry and a lower bound of its distance to the other entries of each group.
When entries have moved, a bound less the group's largest move still holds, and a group is scanned
only if that doesn't exceed the distance to the best entry known. Bounds are rounded down and compared with a
margin; what they can't part is decided by squared distances in exact integers, of which the lower index wins ties.

A round is one pass in ``mapInArrow``: it writes the rows with their new state to the shared folder, and
with them, a row a task, the sums of the parts by entry. These are added up by Spark, and the
codebooks, of fixed size, go through the driver. Sums are dealt in limbs of 32 bits, so that no sum of any table overflows.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than the longest one, and
all if its length is no multiple of ``PARTS``, are filled up with zeros. Rows are ordered by vec_id (null last) and then vector to find the first entries;
repeated rows are rows of their own. With fewer rows than ``ENTRIES`` codebooks are smaller; an empty table gives no rows. Finite
values too large for exact doubles are computed in Python's integers; an error beyond a long is null, and so is its label's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tidemark.llm.common import cut, drop_cut, texts_of

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 16, 64, 2, 6, 256
#: Relative margin of bounds in doubles; rows whose distances are taken at once.
MARGIN, BLOCK = 1e-9, 4096
LIMB = 32


@dataclass
class Codebooks:
    """``books`` [part, entry, position] of integers; ``group`` [part, entry]; ``drift`` [part, group], how far a group's entries moved at most."""

    books: np.ndarray
    group: np.ndarray
    drift: np.ndarray


def exact_limit(size: int) -> float:
    """Largest magnitude of components with which all terms of a squared distance over ``size`` positions are exact doubles."""
    return float(np.sqrt(2.0**51 / max(size, 1)))


def whole(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 * x), as exact doubles, or as Python's integers where doubles don't do."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(np.diff(column.offsets.to_numpy()))
    out = np.zeros((len(column), width))
    if len(flat) == out.size:
        out = flat.reshape(out.shape)
    else:
        sizes = np.diff(ends, prepend=0)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    if np.abs(out).max(initial=0.0) * SCALE <= exact_limit(width // PARTS):
        return np.floor(out * SCALE)
    return np.array([whole(v) for v in out.ravel()], dtype=object).reshape(out.shape)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each entry."""
    if x.dtype == object:
        return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.array([min(v, 10**300) for v in d.ravel()], dtype=float).reshape(d.shape) if d.dtype == object else d)


def rounded_down(bound: np.ndarray) -> np.ndarray:
    """Bounds as half floats that never exceed them."""
    half = np.clip(bound, 0, 65504).astype(np.float16)
    return np.where(half > bound, np.nextafter(half, np.float16(0)), half)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, code: np.ndarray | None = None, lower: np.ndarray | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of one part, its squared distance, new bounds [row, group], and how many distances were taken.

    ``code`` and ``lower`` are the state after the round before, ``drift`` the moves since; without them all groups are scanned.
    """
    n, groups = len(x), [np.flatnonzero(group == g) for g in range(group.max() + 1)]
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), np.array([int(v) for v in book.ravel()], dtype=object).reshape(book.shape)
    if code is None:
        best, far, bound = np.full(n, len(book)), np.full(n, np.inf).astype(x.dtype), np.full((n, len(groups)), -np.inf)
        taken = 0
    else:
        best, far, bound = code.astype(np.int64), ((x - book[code]) ** 2).sum(axis=1), lower.astype(float) - drift
        taken = n
    old, old_far = best.copy(), far.copy()
    found = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(bound[:, g] * (1 - MARGIN) <= roots(far) * (1 + MARGIN))
        d = squares(x[rows], book[members])
        taken += d.size
        first = d.argmin(axis=1)
        least, at = d[np.arange(len(rows)), first], members[first]
        d[np.arange(len(rows)), first] = np.inf if d.dtype != object else 10**700
        found.append((rows, at, least, d.min(axis=1)))
        nearer = (least < far[rows]) | ((least == far[rows]) & (at < best[rows]))
        best[rows[nearer]], far[rows[nearer]] = at[nearer], least[nearer]
    for g, (rows, at, least, second) in enumerate(found):
        left = np.ones(n, dtype=bool)
        left[rows] = False
        bound[rows, g] = roots(np.where(at == best[rows], second, least))
        if code is not None:  # the entry left behind is one of its group's others again
            moved = np.flatnonzero(left & (old != best) & (group[np.minimum(old, len(book) - 1)] == g))
            bound[moved, g] = np.minimum(bound[moved, g], roots(old_far[moved]))
    return best, far, rounded_down(bound * (1 - MARGIN)), taken


def grouped(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds from centres that lie far apart."""
    y = book.astype(float)
    if not np.isfinite((y * y).sum()):
        return np.zeros(len(y), dtype=np.int64)
    centres = [y[0]]
    while len(centres) < min(groups, len(y)):
        centres.append(y[np.min([((y - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    c = np.array(centres)
    for _ in range(rounds):
        own = ((y[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([y[own == g].mean(axis=0) if (own == g).any() else c[g] for g in range(len(c))])
    return np.unique(own, return_inverse=True)[1]


def moves(old: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Largest move of each group's entries, by part; groups that a part doesn't have don't move."""
    out = np.zeros((len(old), GROUPS))
    for p in range(len(old)):
        gone = ((old[p].astype(object) - new[p].astype(object)) ** 2).sum(axis=1)
        step = np.array([float(np.sqrt(float(v))) * (1 + MARGIN) if v < 10**300 else np.inf for v in gone])
        for g in range(group[p].max() + 1):
            out[p, g] = step[group[p] == g].max()
    return out


def limbs(v: int) -> list[int]:
    out = []
    while not -(1 << (LIMB - 1)) <= v < 1 << (LIMB - 1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def encoded(batch: pa.RecordBatch, model: Codebooks, width: int, state: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, integers, codes, squared distances and bounds of each block of a batch (vec_id, label, embedding, and with ``state`` code and lower)."""
    n_groups, size = int(model.group.max()) + 1, width // PARTS
    for lo in range(0, batch.num_rows, BLOCK):
        block = batch.slice(lo, BLOCK)
        x = integers(block.column(2), width)
        codes, far, lower = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), x.dtype), np.zeros((len(x), PARTS, n_groups), np.float16)
        if state:
            was = np.frombuffer(b"".join(block.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            held = np.frombuffer(b"".join(block.column(4).to_pylist()), np.float16).reshape(-1, PARTS, n_groups)
        for p in range(PARTS):
            t = int(model.group[p].max()) + 1
            known = (was[:, p], held[:, p, :t], model.drift[p, :t]) if state else ()
            codes[:, p], d, lower[:, p, :t], _ = assign(x[:, p * size : (p + 1) * size], model.books[p], model.group[p], *known)
            far = far.astype(object) if d.dtype == object else far
            far[:, p] = d
        yield lo, x, codes, far, lower


def lloyd_round(rows: DataFrame, model: Codebooks, width: int, state: bool) -> DataFrame:
    """A table in the shared folder: the rows of ``rows`` with ``code`` and ``lower``, and rows with a task's sums in ``cells``, ``limb`` and ``value``."""
    entries, size = model.books.shape[1], width // PARTS
    schema = rows.select("vec_id", "label", "embedding").schema.add("code", "binary").add("lower", "binary").add("cells", ArrayType(IntegerType())).add("limb", ArrayType(IntegerType())).add("value", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kept = np.zeros((PARTS * entries, size + 1), dtype=object), None
        for batch in batches:
            kept = batch.slice(0, 0)
            for lo, x, codes, _, lower in encoded(batch, model, width, state):
                for p in range(PARTS):
                    at, own = slice(p * entries, (p + 1) * entries), codes[:, p]
                    sums[at, size] += np.bincount(own, minlength=entries)
                    for k in range(size):
                        v = x[:, p * size + k]
                        if v.dtype == object:
                            np.add.at(sums[:, k], own + p * entries, v)
                        else:
                            sums[at, k] += np.bincount(own, v, entries).astype(np.int64)
                block, blank = batch.slice(lo, BLOCK), pa.nulls(len(x))
                made = [pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in lower], pa.binary())]
                yield pa.RecordBatch.from_arrays([*block.columns[:3], *made, blank.cast(pa.list_(pa.int32())), blank.cast(pa.list_(pa.int32())), blank.cast(pa.list_(pa.int64()))], names=schema.names)
        if kept is not None:
            parts = [(cell, i, v) for cell, total in enumerate(sums.ravel()) if total for i, v in enumerate(limbs(int(total)))]
            lists = [pa.array([[x[i] for x in parts]], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in kept.columns[:3]], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *lists], names=schema.names)

    names = ["vec_id", "label", "embedding"] + ["code", "lower"] * state
    return cut(texts_of(rows, *names).mapInArrow(run, schema), "codes")


def refined(written: DataFrame, model: Codebooks) -> Codebooks:
    """Codebooks of the means of what is assigned to each entry, rounded down; unused entries stay."""
    zipped = F.explode(F.arrays_zip("cells", "limb", "value")).alias("c")
    found = written.where("cells is not null").select(zipped).groupBy("c.cells", "c.limb").agg(F.sum("c.value").alias("v")).collect()  # cells of the codebooks
    parts, entries, size = model.books.shape
    sums = np.zeros((parts * entries, size + 1), dtype=object)
    for cell, limb, v in found:
        sums[divmod(cell, size + 1)] += v << (LIMB * limb)
    books = np.array([int(v) for v in model.books.ravel()], dtype=object).reshape(parts * entries, size)
    for e in np.flatnonzero(sums[:, size]):
        books[e] = [v // sums[e, size] for v in sums[e, :size]]
    books = fitted(books.reshape(model.books.shape))
    return Codebooks(books, model.group, moves(model.books, books, model.group))


def fitted(books: np.ndarray) -> np.ndarray:
    """Doubles if they are exact in distances."""
    return books.astype(float) if max((abs(v) for v in books.ravel()), default=0) <= exact_limit(books.shape[2]) else books


def digest(model: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in model.books.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (hexadecimal), error and codebooks_sha256 of every row with a usable vector."""
    kind = dict(vectors.dtypes)["embedding"]
    usable = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding" if kind == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & usable)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS)) * PARTS
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if not first:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("codebooks_sha256", F.lit(""))
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    books = fitted(np.array([int(v) for v in start.ravel()], dtype=object).reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    model, written = Codebooks(books, np.array([grouped(b) for b in books]), np.zeros((PARTS, GROUPS))), None
    for _ in range(rounds):
        before, written = written, lloyd_round(rows if written is None else written.where("code is not null"), model, width, written is not None)
        model = refined(written, model)
        if before is not None:
            drop_cut(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, codes, far, _ in encoded(batch, model, width, True):
                errors = [e if e < 1 << 63 else None for e in (int(v) for v in far.sum(axis=1))]
                block = batch.slice(lo, BLOCK)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    done = cut(texts_of(written.where("code is not null"), "vec_id", "label", "embedding", "code", "lower").mapInArrow(run, schema), "coded")
    drop_cut(written)
    return done.withColumn("codebooks_sha256", F.lit(digest(model)))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors' sum over equal labels, nulls together; null if an error in it is, or if it is beyond a long."""
    whole_sum = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(whole_sum.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_sql() -> str:
    """The plain Lloyd rounds in SQL."""
    assign_sql = "SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {b} b ON b.p = x.p) GROUP BY id, p"
    update_sql = "SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM {b} b LEFT JOIN (SELECT p, e, list(m ORDER BY k) AS v FROM (SELECT a.p, a.e, k, CAST(floor(sum(x.v[k]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM {a} a JOIN x ON x.id = a.id AND x.p = a.p, (SELECT unnest(range(1, w + 1)) AS k FROM (SELECT any_value(len(v)) AS w FROM x)) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.p = b.p AND n.e = b.e"
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(floor({SCALE} * CAST(z AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
        x AS MATERIALIZED (SELECT id, p, v[CAST(p * len(v) / {PARTS} AS BIGINT) + 1 : CAST((p + 1) * len(v) / {PARTS} AS BIGINT)] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
        b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM x WHERE id <= {ENTRIES}), a0 AS MATERIALIZED ({assign_sql.format(b="b0")}), b1 AS MATERIALIZED ({update_sql.format(b="b0", a="a0")}), a1 AS MATERIALIZED ({assign_sql.format(b="b1")}),
        b2 AS MATERIALIZED ({update_sql.format(b="b1", a="a1")}), a2 AS MATERIALIZED ({assign_sql.format(b="b2")}),
        coded AS (SELECT id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM kept JOIN coded USING (id)"""
