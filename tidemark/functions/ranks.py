"""Order statistics of all earlier values of a series, split over tasks by time and by value.

Rows are dealt into blocks of time and buckets of value. How many earlier values don't exceed a row's value, and which earlier values lie
next to it, comes from three places: the row's own block, its bucket in earlier blocks, and the other buckets in earlier blocks. The first
two are counted inside one block or one bucket; the third is a table of counts and ends by block and bucket.
Bucket borders only share out the work; results don't depend on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions.blocks import DAYS, SERIES, block_of
from tidemark.functions.tables import once

#: Buckets of a series' values.
BUCKETS = 64


def earlier(at: np.ndarray, v: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each i, over all j with at[j] < at[i]: the weight of v[j] <= v[i], the largest such v[j], and the smallest v[j] > v[i].

    Two places in order differ first in some binary digit, where the earlier has a zero. For each digit, one sort of all rows by the digits before it and by value sets
    zeros against ones. ``at`` are numbers from zero on.
    """
    count, below, above = np.zeros(len(v), dtype=np.int64), np.full(len(v), -np.inf), np.full(len(v), np.inf)
    for digit in range(int(at.max(initial=0)).bit_length()):
        side = at >> digit & 1
        order = np.lexsort((side, v, at >> (digit + 1)))
        pair, ones, values = (at >> (digit + 1))[order], side[order] == 1, v[order]
        first = np.searchsorted(pair, pair)
        sums = np.concatenate(([0], np.cumsum(np.where(ones, 0, weight[order]))))
        count[order[ones]] += (sums[1:] - sums[first])[ones]
        index = np.arange(len(v))
        down = np.maximum.accumulate(np.where(ones, -1, index))
        up = np.minimum.accumulate(np.where(ones, len(v), index)[::-1])[::-1]
        has_down, has_up = ones & (down >= first), ones & (up < np.searchsorted(pair, pair, "right"))
        below[order[has_down]] = np.maximum(below[order[has_down]], values[down[has_down]])
        above[order[has_up]] = np.minimum(above[order[has_up]], values[up[has_up]])
    return count, below, above


FOUND = ("n", "below", "above")


def _fields(side: str) -> list[StructField]:
    return [StructField(f"_n_{side}", LongType()), StructField(f"_below_{side}", DoubleType()), StructField(f"_above_{side}", DoubleType())]


def _added(rows: pa.Table, side: str, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    for name, x in zip(FOUND, found, strict=True):
        rows = rows.append_column(f"_{name}_{side}", pa.array(x))
    return rows


def earlier_ranks(df: DataFrame, value: str, by: tuple[str, ...] = SERIES, order: str = "date", days: int = DAYS) -> DataFrame:
    """``df`` with _held (earlier values), _upto (those not above the row's), _below and _above (those next to it); nulls are no values and get none."""
    keys, df = [*by, "_block"], once(df)
    blocked = df.withColumns({"_block": block_of(order, days), "_v": F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))})
    cells = blocked.where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    cells = once(cells)
    borders = cells.groupBy(*by).agg(F.percentile_approx("_v", F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)]), F.lit(1000)).alias("_borders"))
    dealt = cells.join(borders, [*by]).withColumn("_bucket", F.size(F.filter("_borders", lambda b: b <= F.col("_v"))).cast("long")).drop("_borders")
    key_fields = [dealt.schema[k] for k in keys]

    def in_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        v = rows["_v"].to_numpy()
        there = np.flatnonzero(~np.isnan(v))
        found = [np.zeros(len(v), dtype=np.int64), np.full(len(v), -np.inf), np.full(len(v), np.inf)]
        for out, x in zip(found, earlier(there, v[there], np.ones(len(there), dtype=np.int64)), strict=True):
            out[there] = x
        held = np.concatenate(([0], np.cumsum(~np.isnan(v))[:-1])) if len(v) else np.zeros(0)
        return _added(rows, "own", tuple(found)).append_column("_held_own", pa.array(held.astype(np.int64)))

    def in_bucket(rows: pa.Table) -> pa.Table:
        at = np.unique(rows["_block"].to_numpy(), return_inverse=True)[1]
        return _added(rows, "bucket", earlier(at, rows["_v"].to_numpy(), rows["_k"].to_numpy())).drop_columns(["_k"])

    def in_grid(rows: pa.Table) -> pa.Table:
        blocks, at = np.unique(rows["_block"].to_numpy(), return_inverse=True)
        bucket = rows["_bucket"].to_numpy()
        n, low, high = np.zeros((len(blocks) + 1, BUCKETS), dtype=np.int64), np.full((len(blocks) + 1, BUCKETS), np.inf), np.full((len(blocks) + 1, BUCKETS), -np.inf)
        n[at + 1, bucket], low[at + 1, bucket], high[at + 1, bucket] = (rows[c].to_numpy() for c in ("_k", "_low", "_high"))
        n, low, high = np.cumsum(n, axis=0), np.minimum.accumulate(low, axis=0), np.maximum.accumulate(high, axis=0)
        before = lambda x, none: np.concatenate((np.full((len(x), 1), none), x[:, :-1]), axis=1)
        fewer, below = before(np.cumsum(n, axis=1), 0), before(np.maximum.accumulate(high, axis=1), -np.inf)
        above = before(np.minimum.accumulate(low[:, ::-1], axis=1), np.inf)[:, ::-1]
        held = pa.array(n.sum(axis=1)[at])
        return _added(rows.drop_columns(["_k", "_low", "_high"]), "grid", (fewer[at, bucket], below[at, bucket], above[at, bucket])).append_column("_held_grid", held)

    own = blocked.groupBy(*keys).applyInArrow(in_block, StructType([*blocked.schema.fields, *_fields("own"), StructField("_held_own", LongType())]))
    bucketed = dealt.groupBy(*by, "_bucket").applyInArrow(in_bucket, StructType([f for f in dealt.schema.fields if f.name != "_k"] + _fields("bucket")))
    grid = dealt.groupBy(*keys, "_bucket").agg(F.sum("_k").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    gridded = grid.groupBy(*by).applyInArrow(in_grid, StructType([*key_fields, StructField("_bucket", LongType()), *_fields("grid"), StructField("_held_grid", LongType())]))
    out = own.join(bucketed.join(gridded, [*keys, "_bucket"]), [*keys, "_v"], "left")
    have = F.col("_v").isNotNull()
    found = {
        "_held": F.col("_held_own") + F.col("_held_grid"), "_upto": F.col("_n_own") + F.col("_n_bucket") + F.col("_n_grid"),
        "_below": F.greatest("_below_own", "_below_bucket", "_below_grid"), "_above": F.least("_above_own", "_above_bucket", "_above_grid"),
    }
    return out.select(*df.columns, *[F.when(have, x).alias(n) for n, x in found.items()])


def expanding_bins(df: DataFrame, value: str, name: str, bins: int, least: int, by: tuple[str, ...] = SERIES, order: str = "date", days: int = DAYS) -> DataFrame:
    """``df`` with ``name``: 1 to ``bins`` by interpolated quantiles of strictly earlier values, of which ``least`` must be there.

    A value equal to an edge goes to the upper bin. An edge lies between two neighbours in rank, so it is compared by the number of values up to the row's; only an edge
    between the row's own neighbours is computed.
    """
    if bins <= 1:
        return df.withColumn(name, F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.lit(1)))
    ranked = earlier_ranks(df, value, by, order, days)

    def reached(k: int) -> Column:
        at = (F.col("_held") - 1) * F.lit(k) / F.lit(float(bins))
        low = F.floor(at)
        edge = F.when(at == low, F.col("_below")).otherwise(F.col("_below") + (at - low) * (F.col("_above") - F.col("_below")))
        return F.when(low + 1 < F.col("_upto"), 1).when(low >= F.col("_upto"), 0).when(edge <= F.col(value), 1).otherwise(0)

    count = F.lit(1)
    for k in range(1, bins):
        count = count + reached(k)
    return ranked.withColumn(name, F.when(F.col("_held") >= max(least, 1), count).cast("int")).drop("_held", "_upto", "_below", "_above")
