"""Prefixes over a series in two levels, so that one series is split over many tasks.

A series is cut into blocks of calendar days. What an associative operation makes of each block is a short table;
what it makes of all blocks before one is computed on that, and inside a block a window (or a vectorised scan) starts from there.
The operations are sums, extremes, products and last values, and affine maps y -> a y + b, of which all recursive means are made.

What is read twice, for its summaries and for its rows, is written once. Blocks are the same wherever the rows lie, and results don't depend on ``days`` but for the rounding of sums and products.
Rows without a ticker belong to no series: they see their own block only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions.tables import once

#: Calendar days of a block.
DAYS = 1024
SERIES = ("ticker",)


@dataclass(frozen=True)
class Monoid:
    """``over``: the aggregate, also used as a window's; ``join``: a value before and one after it put together."""

    over: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


def _either(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b))


MONOIDS = {
    "sum": Monoid(F.sum, _either(lambda a, b: a + b)),
    "max": Monoid(F.max, lambda a, b: F.greatest(a, b)),
    "min": Monoid(F.min, lambda a, b: F.least(a, b)),
    "product": Monoid(F.product, _either(lambda a, b: a * b)),
    "last": Monoid(lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
    "first": Monoid(lambda x: F.first(x, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


@dataclass(frozen=True)
class Prefix:
    """``kind`` of the values of ``x`` up to each row, or before it."""

    kind: str
    x: Column
    before: bool = False


def block_of(order: str, days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(order)) / days)


def prefixes(df: DataFrame, columns: dict[str, Prefix], by: tuple[str, ...] = SERIES, order: str = "date", days: int = DAYS) -> DataFrame:
    """``df`` with a column for each prefix, over the rows of equal ``by`` in the order of ``order``."""
    keys, df = [*by, "_block"], once(df)
    blocked = df.withColumns({"_block": block_of(order, days)} | {f"_x{i}": p.x for i, p in enumerate(columns.values())})
    inside = Window.partitionBy(*keys).orderBy(order)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own, totals, carried, out = {}, [], [], {}
    for i, (name, p) in enumerate(columns.items()):
        x, m = F.col(f"_x{i}"), MONOIDS[p.kind]
        own[f"_i{i}"] = m.over(x).over(inside.rowsBetween(Window.unboundedPreceding, -1 if p.before else 0))
        there = F.when(x.isNotNull(), F.col(order))
        totals.append({"last": F.max_by(x, there), "first": F.min_by(x, there)}.get(p.kind, m.over(x)).alias(f"_t{i}"))
        carried.append(m.over(F.col(f"_t{i}")).over(earlier).alias(f"_c{i}"))
        out[name] = m.join(F.col(f"_c{i}"), F.col(f"_i{i}"))
    before = blocked.groupBy(*keys).agg(*totals).select(*keys, *carried)
    kept = [c for c in df.columns if c not in columns]
    return blocked.withColumns(own).join(before, keys, "left").select(*kept, *[x.alias(name) for name, x in out.items()])


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the maps y -> a y + b, each one applied after all before it: a scan in log2 rounds of whole arrays."""
    a, b = a.astype(float), b.astype(float)
    step = 1
    while step < len(a):
        # the maps ``step`` before are put under these; both sides are read before either is written
        b[step:], a[step:] = b[step:] + a[step:] * b[:-step], a[step:] * a[:-step]
        step *= 2
    return a, b


def carried(
    df: DataFrame, summary: Callable[[pa.Table], list[float]], chain: Callable[[list[list[float]]], list[list[float]]], columns: Callable[[pa.Table, list[float] | None], dict[str, np.ndarray]], names: list[str], by: tuple[str, ...] = SERIES, order: str = "date", block: Column | None = None
) -> DataFrame:
    """``df`` with the double columns ``names``, for what depends on all rows before in a way that a block sums up in a few numbers.

    ``summary`` makes a list of doubles of a block's rows, ``chain`` of the lists of a series' blocks, in order, what each block starts from, and
    ``columns`` of a block's rows and that (none if the block has no series) the new columns. Rows are dealt by series and block once; the two passes over a block are its own tasks', and
    only summaries, some numbers a block, come together by series. ``block`` numbers the blocks, else they are ``DAYS`` calendar days.
    """
    keys, df = [*by, "_block"], once(df)
    blocked = df.withColumn("_block", block_of(order, DAYS) if block is None else block)
    key_fields = [blocked.schema[k] for k in keys]
    rows = blocked.select(*[c for c in blocked.columns if c not in names])

    def summed(block: pa.Table) -> pa.Table:
        made = pa.array([summary(block.sort_by(order))], pa.list_(pa.float64()))
        return block.select(keys).slice(0, 1).append_column("_sum", made)

    def chained(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("_block")
        return blocks.select(keys).append_column("_start", pa.array(chain(blocks["_sum"].to_pylist()), pa.list_(pa.float64())))

    def applied(block: pa.Table, start: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        made = columns(block, start["_start"][0].as_py() if start.num_rows else None)
        for name in names:
            block = block.append_column(name, pa.array(made[name], pa.float64(), from_pandas=True))
        return block.drop_columns(["_block"])

    sums = rows.groupBy(*keys).applyInArrow(summed, StructType([*key_fields, StructField("_sum", ArrayType(DoubleType()))]))
    starts = sums.groupBy(*by).applyInArrow(chained, StructType([*key_fields, StructField("_start", ArrayType(DoubleType()))]))
    out = StructType([f for f in rows.schema.fields if f.name != "_block"] + [StructField(n, DoubleType()) for n in names])
    return rows.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(applied, out)


def jumps(p: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted positions, the first one ``gap`` or more ahead (their number if there is none), and the last one that such steps reach."""
    to, last = np.searchsorted(p, p + gap), np.arange(len(p))
    ahead = to
    while (go := ahead < len(p)).any():  # pointers double: each round looks twice as far
        last = np.where(go, last[np.minimum(ahead, len(p) - 1)], last)
        ahead = np.where(go, ahead[np.minimum(ahead, len(p) - 1)], ahead)
    return to, last


def reached(to: np.ndarray, first: int) -> np.ndarray:
    """Which positions the steps from ``first`` reach: in each round all that are twice as many steps away."""
    out = np.zeros(len(to) + 1, dtype=bool)
    out[first] = True
    to = np.append(to, len(to))
    while not out[to[out]].all():
        out[to[out]] = True
        to = to[to]
    return out[:-1]


def spaced(positions: DataFrame, by: tuple[str, ...], size: int = 4096) -> DataFrame:
    """The rows of ``positions`` (..., pos, gap) kept greedily: by series the first ``pos``, then each next one ``gap`` or more after the last kept; of equal ones one.

    Positions are cut into blocks of ``size``. In a block, pointers to the next position allowed are doubled. All that a block needs to know of those before it is how far into it
    nothing is allowed yet, a number up to ``gap``; so a block makes a table of ``gap`` + 1 numbers, from that to the same of the next block.
    """

    def parts(block: pa.Table) -> tuple[np.ndarray, int, int]:
        p = block["pos"].to_numpy()
        return p, int(block["gap"][0].as_py()), int(p[0] // size) * size

    def summary(block: pa.Table) -> list[float]:
        p, gap, start = parts(block)
        _, last = jumps(p, gap)
        at = np.searchsorted(p - start, np.arange(gap + 1))
        free = np.where(at < len(p), p[last[np.minimum(at, len(p) - 1)]] + gap, start + np.arange(gap + 1))
        return [float(start // size), *np.maximum(free - start - size, 0).astype(float)]

    def chain(blocks: list[list[float]]) -> list[list[float]]:
        offset, at, out = 0, None, []
        for number, *table in blocks:
            offset = max(0, offset - size * int(number - at - 1)) if at is not None else 0
            out.append([float(offset)])
            offset, at = int(table[offset]), number
        return out

    def columns(block: pa.Table, start: list[float] | None) -> dict[str, np.ndarray]:
        p, gap, at = parts(block)
        return {"_kept": reached(jumps(p, gap)[0], int(np.searchsorted(p - at, (start or [0.0])[0]))).astype(float)}

    return carried(positions, summary, chain, columns, ["_kept"], by, "pos", F.floor(F.col("pos") / size)).where("_kept = 1").drop("_kept")
