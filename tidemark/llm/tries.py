"""Prefix trie of conversations by prefix-doubling naming.

A block is a run of 2^k turns that starts at a multiple of its size. Blocks are named round by round: a turn by what it
says, a block by the names of its halves, so that log2 of the longest conversation rounds name all blocks. A prefix of d turns is
composed of the blocks of d's binary digits, largest first: what is left without d's lowest digit is a prefix named before,
and the pair of its name and the last block's is named in turn. A round of composing does all lengths of one more digit.

Names must be equal where what they stand for is equal, and only there; blocks and prefixes are compared at one place and length only. So a name
is the smallest conv_id that has the block or prefix there: as good as a number of a dense numbering, without numbering all of them, and a prefix's
name is what its node is called by. A name is found by an aggregation that combines before it shuffles, written to the shared folder and joined back,
so that a first turn that a third of all conversations share is split over tasks.

Turns are ordered by turn (null first), and those of one turn by a digest of what they say. Rows without a conv_id belong to no conversation. Null roles and
texts are empty. Repeated rows are turns of their own. Places are sums over ranges of sorted rows, so one conversation may hold most rows. An empty table has no nodes.
A text counts by its code points; a turn is known by the MD5 of its role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut

#: Conversations that share a base, and the bound of the turns taken from it.
FAMILY, SHARED = 100, 6
#: Depths in a block of the sums along a conversation; ids that are joined to one string.
DEPTHS, IDS = 4096, 1 << 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), sym and chars of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("sym"), F.length(text).cast("long").alias("chars")
    )
    counted = said.groupBy("conv_id", "turn", "sym", "chars").agg(F.count("*").alias("n"))
    ranged = cut(counted.repartitionByRange("conv_id", "turn", "sym").withColumn("range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "sym").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("conv_id", "range").agg(F.sum("n").alias("_n")).select("conv_id", "range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, ["conv_id", "range"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_copy")
    out = cut(placed.select("conv_id", (F.col("_before") + F.col("_in")).alias("_first"), "sym", "chars", copies).select("conv_id", (F.col("_first") + F.col("_copy")).alias("pos"), "sym", "chars"), "turns")
    drop_cut(ranged)
    return out


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id and size of every rebuilt conversation; conv_id, d (from 1), sym and chars of their turns.

    The first h turns of conversation c - c % 100, then the own turns after the first h; h is the crc32 of the decimal c, modulo 6.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    named = own.withColumns({"h": h, "base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))})
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < SHARED))
    held = heads.groupBy(F.col("conv_id").alias("base")).agg((F.max("pos") + 1).alias("_held"))
    convs = cut(named.join(held, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("_held", F.lit(0))).alias("taken"), "n"), "convs")
    before = convs.join(heads.select(F.col("conv_id").alias("base"), "pos", "sym", "chars"), "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "sym", "chars")
    after = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "sym", "chars")
    size = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", size.alias("size")), cut(before.unionByName(after), "rebuilt")


def named(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (with conv_id) with ``name``, the smallest conv_id of the rows equal in ``by``, written to the shared folder in place of ``rows``."""
    names = cut(rows.groupBy(*by).agg(F.min("conv_id").alias("name")), "names")
    out = cut(rows.join(names, by), "named")
    drop_cut(names)
    drop_cut(rows)
    return out


def block_names(rebuilt: DataFrame, longest: int) -> list[DataFrame]:
    """For each k, conv_id, j and name of the blocks of 2^k turns that start at turn j * 2^k (counted from 0)."""
    level = named(cut(rebuilt.select("conv_id", (F.col("d") - 1).alias("j"), "sym"), "level"), ["j", "sym"])
    levels = [level]
    while 2 ** len(levels) <= longest:
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name"))).alias("right" if odd else "left")
        pairs = level.groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(half(0), half(1)).where("right is not null")
        level = named(cut(pairs, "level"), ["j", "left", "right"])
        levels.append(level)
    return [x.select("conv_id", "j", "name") for x in levels]


def prefix_names(levels: list[DataFrame]) -> DataFrame:
    """conv_id, d and name of every prefix: the blocks of d's binary digits put together, a digit more in each round."""
    last = None
    for k, level in enumerate(levels):
        ends = level.where("j % 2 = 0").select("conv_id", ((F.col("j") + 1) * 2**k).alias("d"), (F.col("j") * 2**k).alias("rest"), F.col("name").alias("block"))
        last = ends if last is None else last.unionByName(ends)
    ends = cut(last, "ends")
    found = [cut(ends.where("rest = 0").select("conv_id", "d", F.col("block").alias("name")), "prefixes")]
    for digits in range(2, len(levels) + 1):
        left = ends.where(F.bit_count("d") == digits)
        both = left.join(found[-1].select("conv_id", F.col("d").alias("rest"), F.col("name").alias("prefix")), ["conv_id", "rest"])
        found.append(named(cut(both.select("conv_id", "d", "prefix", "block"), "composed"), ["d", "prefix", "block"]).select("conv_id", "d", "name"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ends_digest(ends: DataFrame) -> DataFrame:
    """d, name and sha of the ids of each node's conversations that end there, in order, joined by commas.

    Ids become strings of up to ``IDS`` ids in sorted ranges; only these strings meet by node, and are hashed as they come.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, str]] = []
        node, ids = None, []

        def close() -> None:
            if ids:
                rows.append((*node, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for d, name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, name) != node or len(ids) >= IDS:
                    close()
                    node, ids = (d, name), []
                ids.append(conv)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("d", "name", "first", "ids"), r, strict=True)) for r in rows])
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "name", "first", "ids"), r, strict=True)) for r in rows])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for d, name, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (d, name) == node:
                    sha.update(b",")
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (d, name), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("d", "name", "sha"), r, strict=True)) for r in done])
        if node:
            yield pa.RecordBatch.from_pylist([{"d": node[0], "name": node[1], "sha": sha.hexdigest()}])

    key = ["d", "name", "conv_id"]
    strings = ends.select(key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(joined, "d long, name long, first long, ids string")
    return strings.repartition("d", "name").sortWithinPartitions("d", "name", "first").mapInArrow(hashed, "d long, name long, sha string")


def sums_below(rows: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (conv_id, d) with each value summed over the conversation's rows of this d or more: by block of depths, then inside it."""
    blocked = rows.withColumn("_b", F.floor(F.col("d") / DEPTHS))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "_b").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocked.groupBy("conv_id", "_b").agg(*[F.sum(v).alias(v) for v in values]).select("conv_id", "_b", *[F.coalesce(F.sum(v).over(deeper), F.lit(0)).alias(f"_{v}") for v in values])
    own = blocked.select("conv_id", "d", "_b", *[c for c in rows.columns if c not in ("conv_id", "d", *values)], *[F.sum(v).over(inside).alias(v) for v in values])
    return own.join(blocks, ["conv_id", "_b"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_b", *[f"_{v}" for v in values])


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    What a subtree holds is summed along conversations: each node's share stands once, in the row of the conversation it is called by, and
    the sums from there on down are added up over a node's members. So the work is linear in turns, whatever the depth.
    """
    turns = ordered_turns(conversations)
    convs, rebuilt = rebuilt_turns(turns)
    root, longest = convs.agg(F.min("conv_id"), F.max("size")).first()
    prefixes = prefix_names(block_names(rebuilt, longest or 0))
    paths = cut(prefixes.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("name"))), "paths")
    counted = cut(paths.groupBy("d", "name").agg(F.count("*").alias("n_convs")), "counted")
    chars = rebuilt.select(F.col("conv_id").alias("name"), "d", "chars")
    parents = paths.select(F.col("conv_id").alias("name"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = cut(counted.join(chars, ["name", "d"], "left").join(parents, ["name", "d"], "left"), "nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    saved = F.when(F.col("d") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    full = cut(nodes.join(children, ["d", "name"], "left").select("d", "name", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved")), "full")
    shares = full.select(F.col("name").alias("conv_id"), "d", F.col("saved").alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    summed = sums_below(cut(paths.join(shares, ["conv_id", "d"], "left").na.fill(0, ["saved_tokens", "n_leaves"]), "shares"), ["saved_tokens", "n_leaves"])
    below = summed.groupBy("d", "name").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = ends_digest(paths.join(convs.select("conv_id", F.col("size").alias("d")), ["conv_id", "d"]))
    out = full.join(below, ["d", "name"]).join(ends, ["d", "name"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256")
    )


def op13_sql() -> str:
    """The trie by whole lists of turns, for conversations of few turns."""
    bits = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, len(s) + 1), lambda i: list_transform(range(8), lambda b: CAST((ascii(s[i]) >> b) & 1 AS BIGINT)))), lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)), 4294967295)"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        listed AS MATERIALIZED (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST) AS l FROM turns GROUP BY 1),
        convs AS (SELECT conv_id, l, CAST(({bits}) % {SHARED} AS BIGINT) AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM listed)),
        built AS MATERIALIZED (SELECT c.conv_id, coalesce(b.l, [])[1 : c.h] || c.l[c.h + 1 :] AS l FROM convs c LEFT JOIN listed b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
        paths AS MATERIALIZED (SELECT conv_id, len(l) AS size, d, CASE WHEN d > 0 THEN l[d]['text'] ELSE '' END AS last, sha256(CAST(l[1 : d] AS VARCHAR)) AS key FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM built)),
        counted AS MATERIALIZED (SELECT d, key, min(conv_id) AS name, count(*) AS n, any_value(length(last)) AS chars, coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM paths GROUP BY 1, 2),
        nodes AS MATERIALIZED (SELECT c.*, u.key AS above FROM counted c LEFT JOIN paths u ON u.conv_id = c.name AND u.d = c.d - 1),
        kids AS (SELECT above AS key, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
        full_ AS MATERIALIZED (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, key)),
        below AS (SELECT u.d, u.key, sum(CASE WHEN f.d > 0 THEN (f.n - 1) * f.chars ELSE 0 END) AS saved, count(*) FILTER (WHERE f.k = 0) AS leaves FROM full_ f JOIN paths u ON u.conv_id = f.name AND u.d <= f.d GROUP BY 1, 2)
        SELECT f.name AS conv_id, f.d AS depth, p.name AS parent_conv_id, f.n AS n_convs, f.k AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM full_ f JOIN below b USING (d, key) LEFT JOIN counted p ON p.d = f.d - 1 AND p.key = f.above"""
