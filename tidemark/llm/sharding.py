"""Sharding by a minimax contiguous partition; DataFrame operations only.

Equal texts are one atomic group. Groups stand in the order of their digest. The smallest
capacity with which a greedy walk over the ordered groups fills at most ``shards`` shards is
found by search: each round tries ``TRIES`` capacities between the bounds at once. Walks look
up prefix sums by block of digests and go into a block only where a cut falls. Rows get their place in a shard from sums by block of digests, by group and by
part of a group, so a text that a third of all rows share is dealt over many tasks.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut

SHARDS, TRIES = 16, 48
#: Hex digits of a digest that name a block; parts that the rows of a group are dealt to.
BLOCK_DIGITS, PARTS = 3, 256


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, group digest and part of every row.

    A null text has size 1 and the crc of no bytes, and is no group-mate of an empty text.
    """
    raw = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        F.coalesce(F.sha2(raw, 256), F.lit("0" * 64)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"),
    )


def running(over: list[str], by: list[str]):
    return Window.partitionBy(*over).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def before(groups: DataFrame, value: str, name: str) -> DataFrame:
    """``groups`` with the sum of ``value`` over all groups of smaller digest: by block, then inside it.

    There are 16 ** BLOCK_DIGITS blocks at most, so their sums are a table of bounded size.
    """
    sums = groups.groupBy("block").agg(F.sum(value).alias("_v"))
    blocks = sums.select("block", F.coalesce(F.sum("_v").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum(value).over(running(["block"], ["digest"])), F.lit(0))
    return groups.withColumn("_i", inside).join(F.broadcast(blocks), "block").withColumn(name, (F.col("_b") + F.col("_i")).cast("long")).drop("_b", "_i")


class Ends:
    """Where groups end, looked up by prefixes of their digests.

    Of a prefix only the sums of its next ``BLOCK_DIGITS`` digits are fetched, a table of bounded
    size, and only when a walk needs it; one job fetches what all walks need next.
    """

    def __init__(self, groups: DataFrame) -> None:
        self.groups, self.nodes = groups, {}
        self.fetch({""})

    def fetch(self, prefixes: set[str]) -> None:
        for size in {len(p) for p in prefixes}:
            own = F.substring("digest", 1, size) if size else F.lit("")
            child = F.substring("digest", 1, size + BLOCK_DIGITS)
            kept = self.groups.where(own.isin([p for p in prefixes if len(p) == size]))
            rows = kept.groupBy(child.alias("p")).agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("bytes")).alias("b"), F.count("*").alias("n")).orderBy("p").collect()
            for p in prefixes:
                if len(p) == size:
                    mine = [r for r in rows if r["p"].startswith(p)]
                    self.nodes[p] = ([r["b"] for r in mine], mine)

    def last(self, reach: int, floor: int, prefix: str = "") -> tuple[int, str | None]:
        """The largest end up to ``reach``, at least ``floor``; or the prefix that must be fetched to tell."""
        if prefix not in self.nodes:
            return floor, prefix
        ends, rows = self.nodes[prefix]
        k = bisect_right(ends, reach)
        floor = max(floor, ends[k - 1]) if k else floor
        if k < len(rows) and rows[k]["n"] > 1 and rows[k]["a"] < reach:
            return self.last(reach, floor, rows[k]["p"])
        return floor, None


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity and its cuts: prefix sums at which shards 1, 2, ... begin.

    ``groups`` has ``digest``, ``start`` (bytes before) and ``bytes``, cut to the shared folder.
    """
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the upper one always suffices
    ends = Ends(groups)

    def walk(capacities: list[int]) -> list[list[int]]:
        cuts: list[list[int]] = [[0] for _ in capacities]
        live = set(range(len(capacities)))
        while live:
            missing = set()
            for i in sorted(live):
                while True:
                    if cuts[i][-1] == total or len(cuts[i]) > shards:
                        live.discard(i)
                        break
                    end, lacks = ends.last(cuts[i][-1] + capacities[i], cuts[i][-1])
                    if lacks is not None:
                        missing.add(lacks)
                        break
                    cuts[i].append(end)
            if missing:
                ends.fetch(missing)
        return cuts

    best = walk([high])[0]
    while low < high:
        tries = sorted({low + (high - low) * k // TRIES for k in range(TRIES)})
        for capacity, cuts in zip(tries, walk(tries), strict=True):
            if cuts[-1] == total:
                high, best = capacity, cuts
                break
            low = capacity + 1
    return high, best[1:-1]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row.

    Shards hold whole groups of equal texts and near equal bytes: the largest is as small as
    any contiguous cut of the ordered groups allows. ``slot`` runs from 0 in each shard, by
    digest, part of the group and doc_id. An empty table gives no rows.
    """
    rows = cut(sized_rows(docs), "rows")
    parts = cut(rows.groupBy("digest", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "parts")
    groups = parts.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("block", F.substring("digest", 1, BLOCK_DIGITS))
    groups = cut(before(before(cut(groups, "groups"), "bytes", "start"), "n", "row"), "placed")
    _, cuts = smallest_capacity(groups, shards)
    shard = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    groups = groups.withColumn("shard", shard)
    first = groups.groupBy("shard").agg(F.min("row").alias("_first"))  # a row a shard
    groups = cut(groups.join(F.broadcast(first), "shard").select("digest", "shard", (F.col("row") - F.col("_first")).alias("at")), "sharded")
    parts_at = parts.select("digest", "part", F.coalesce(F.sum("n").over(running(["digest"], ["part"])), F.lit(0)).alias("_in"))
    parts_at = cut(parts_at.join(groups, "digest").select("digest", "part", "shard", (F.col("at") + F.col("_in")).alias("at")), "at")
    drop_cut(parts)
    nth = F.row_number().over(Window.partitionBy("digest", "part").orderBy("doc_id")) - 1
    return (
        rows.withColumn("_nth", nth)
        .join(parts_at, ["digest", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("_nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
