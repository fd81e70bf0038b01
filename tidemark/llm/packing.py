"""Best-fit packing of token pieces by the linear grouping scheme.

Only the histogram of piece lengths, at most ``capacity`` rows, reaches the driver. Large
lengths are put in groups of equal numbers of pieces and rounded up to their group's
largest; configurations of these few sizes are optimised as a linear program by column
generation; whole multiples of its configurations become sequences; actual lengths take the
rounded places, the last place of a configuration to the length that leaves least room; what
is left of the large pieces and all small ones go best-fit, longest first, into the fullest
sequence with room. The best of ``GROUPS`` numbers of groups is kept. All of this works
on runs of equal sequences, so its work depends on the capacity and not on the number of
pieces. The plan names, for ranks lo to hi among pieces of a length, the sequences and
offsets; Spark ranks the pieces within each length, in buckets so that a common length
is dealt over many tasks, and joins the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, texts_of
from tidemark.llm.tokens import ended

CAPACITY, END_ID = 1024, 2
#: Lengths over this share of the capacity are large; numbers of groups tried.
SMALL, GROUPS = 1 / 4, (8, 10, 12, 16, 24, 48)
#: Shares of the configurations that are used; actual lengths compete for the rest.
SHARES = (1.0, 0.9, 0.6, 0.3)
#: Buckets in which the pieces of a length are ranked.
BUCKETS = 1024


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (little-endian unsigned 32-bit) of every document.

    A document's ids are its text's and ``end_id``; a null text counts as empty, which leaves
    the end id. One longer than ``capacity`` is cut so that all pieces but the first are full.
    """
    ids = docs.select("doc_id")
    schema = ids.schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = ended(batch.column(1), path, end_id)
            total = np.diff(at)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            head = (total - (count - 1) * capacity)[row]  # the first piece may be shorter
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            edges = pa.array(4 * np.append(at[row] + start, len(ids)), pa.int64())
            parts = pa.Array.from_buffers(pa.large_binary(), len(row), [None, edges.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), parts.cast(pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return texts_of(docs, "doc_id", "text").mapInArrow(run, schema)


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill one sequence at the highest worth: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        value = np.where(fits, best[np.maximum(room - sizes, 0)] + worth, -1)
        k = int(value.argmax())
        best[room], last[room] = (value[k], k) if value[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out[last[room]] += 1
            room -= sizes[last[room]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole times) from the linear program over all configurations of ``sizes``."""
    basis = np.diag((capacity // sizes).astype(float))
    times = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if new @ worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * step, 0)
        basis[:, out], times[out] = new, ratio[out]
    return [(basis[:, k].astype(int), int(times[k] + 1e-6)) for k in range(len(sizes)) if times[k] >= 1]


def equal_groups(lengths: list[int], left: dict[int, int], groups: int) -> list[list[int]]:
    """Large lengths, longest first, in runs of about equal numbers of pieces; no length is split."""
    total, out, held = sum(left[x] for x in lengths), [[]], 0
    for x in lengths:
        if out[-1] and held + left[x] / 2 > total / groups * len(out):
            out.append([])
        out[-1].append(x)
        held += left[x]
    return out


def grouped(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[list[int]], list[tuple[np.ndarray, int]]]:
    """The groups of large lengths, and the configurations of their rounded sizes."""
    left = {k: v for k, v in histogram.items() if v}
    large = sorted((x for x in left if x > capacity * SMALL), reverse=True)
    if not large or not groups:
        return [], []
    members = equal_groups(large, left, groups)
    demand = np.array([sum(left[x] for x in g) for g in members], dtype=float)
    return members, configurations(np.array([g[0] for g in members]), demand, capacity)


def plan(histogram: dict[int, int], capacity: int, grouping: tuple[list[list[int]], list[tuple[np.ndarray, int]]], share: float = 1.0) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Number of sequences, and rows (length, lo, hi, sequence, per sequence, offset).

    The pieces of a length with ranks lo to hi - 1 fill ``per sequence`` places, from
    ``offset`` on, of each sequence from ``sequence`` on. Each configuration is used ``share`` of its times.
    """
    left = {k: v for k, v in histogram.items() if v}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences

    def put(length: int, n: int, first: int, each: int, used: int) -> None:
        rows.append((length, rank[length], rank[length] + n, first, each, used))
        rank[length] += n
        left[length] -= n

    def fill(runs: list, choose: Callable[[int], int | None], again: bool = False) -> list:
        """Give each sequence of ``runs`` one more piece, or while any fits; runs split where a length ends."""
        done, waiting = [], list(reversed(runs))
        while waiting:
            lo, hi, used = waiting.pop()
            x = choose(capacity - used) if lo < hi else None
            if x is None:
                done.append((lo, hi, used))
                continue
            n = min(hi - lo, left[x])
            put(x, n, lo, 1, used)
            if lo + n < hi:
                waiting.append((lo + n, hi, used))
            (waiting if again else done).append((lo, lo + n, used + x))
        return done

    lengths = sorted(left, reverse=True)
    members, shapes = grouping
    for shape, times in shapes:
        slots = np.repeat(np.arange(len(shape)), shape)
        times = min(int(times * share), sum(left[x] for x in members[slots[0]]))
        runs = [(opened, opened + times, 0)]  # first, end, used
        opened += times
        for g in slots[:-1]:
            runs = fill(runs, lambda room, g=g: next((x for x in members[g] if left[x]), None))
        # the last place of a configuration goes to the actual length that leaves least room, and so on
        runs = fill(runs, lambda room: next((x for x in lengths if x <= room and left[x]), None), again=True)
        for lo, hi, used in runs:
            room.setdefault(capacity - used, []).append((lo, hi))
    for x in sorted(left, reverse=True):
        while left[x]:
            r = min((r for r in room if r >= x and room[r]), default=0)
            if r:
                lo, hi = room[r].pop()
            else:
                r, lo = capacity, opened
                hi = opened = opened + -(-left[x] // (capacity // x))
            each = r // x
            whole = min(hi - lo, left[x] // each)
            if whole:
                put(x, whole * each, lo, each, capacity - r)
                room.setdefault(r - each * x, []).append((lo, lo + whole))
                lo += whole
            if lo < hi and left[x]:
                n = left[x]
                put(x, n, lo, n, capacity - r)
                room.setdefault(r - n * x, []).append((lo, lo + 1))
                lo += 1
            if lo < hi:
                room.setdefault(r, []).append((lo, hi))
    return opened, rows


def best_plan(histogram: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    return min((plan(histogram, capacity, grouping, share) for grouping in [grouped(histogram, capacity, g) for g in GROUPS] for share in SHARES), key=lambda p: p[0])


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with a sequence_id and an offset for each row; ``length`` is 1 to ``capacity``.

    A piece of ``capacity`` is a sequence of its own and isn't shuffled. Rows that are equal in
    ``order`` are told apart by nothing and may swap places; each still
    has its own. An empty table gives no rows. Other columns go along.
    """
    spark = pieces.sparkSession
    rows = cut(pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")), "pieces")
    counts = cut(rows.where(rows["length"].isNull() | (F.col("length") != capacity)).groupBy("length", "_bucket").count(), "lengths")
    histogram = {r["length"]: int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").limit(capacity + 1).collect()}
    if any(x is None or not 1 <= x < capacity for x in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    opened, places = best_plan(histogram, capacity)
    # at most BUCKETS rows a length; the join finds both sides dealt by its keys already
    w = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    planned = spark.createDataFrame(places, "_length long, _lo long, _hi long, _first long, _each long, _used long")  # its size depends on the capacity
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = rows.where(F.col("length") < capacity).withColumn("_nth", nth).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    found = ranked.join(F.broadcast(planned), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    t = F.col("_rank") - F.col("_lo")
    placed = found.select(
        *pieces.columns,
        (F.col("_first") + F.floor(t / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_used") + (t % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
    # the written table's splits are the same in any attempt, and so are these numbers
    full = rows.where(F.col("length") == capacity).select(*pieces.columns, (F.monotonically_increasing_id() + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids, and the place of each."""
    return pack(token_pieces(docs, path, capacity, end_id), ["doc_id", "piece"], capacity)
