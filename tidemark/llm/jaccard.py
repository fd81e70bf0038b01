"""Join of documents on the Jaccard similarity of their word shingles, by vertical partitioning of the global n-gram order.

The order puts n-grams by how many texts have them, rare ones first, ties by their hash. Pivots cut it into ``FRAGMENTS``, and each
document's n-grams into a segment a fragment. For a pair of documents the overlaps of their segments are counted fragment by fragment and
summed; a pair links if 100 * overlap >= 80 * union. Counting is exact; n-grams and whole sets are known by 64-bit hashes.

What is compared:

* Equal sets are one node before anything is compared, so a third of all documents may be copies of one.
* A linking pair shares at least ceil(0.8 n) of either's n shingles, so a document with n - ceil(0.8 n) + 1 shingles that no other set has links with nothing.
  This is counted in two passes: over the n-grams whose hash lies in the lowest ``FIRST`` of the range, for all documents, then over all n-grams of the documents left.
  Both counts hold as they are, as every set has all its n-grams of that range counted.
* In the global order, a linking pair meets in an n-gram of the first n - ceil(0.8 n) + 1 of both. Documents meet there by n-gram, and only if
  their sizes, their places in the order and the parity of their members leave room for the overlap.

Members of an n-gram meet in rounds: first the one with the fewest n-grams of its own, as the likeliest original, and those of their block of about ``BLOCK`` by a hash of the document, then in blocks that grow ``GROWTH``-fold to the whole, in which
only documents outside of the n-gram's largest known component meet others. Copies of one text with a few changes are thus one component after
a round or two, with some pairs a member; who stays alone has met all others at the end. No block or pair is left out.
Words are split at ASCII white space and A to Z lower-cased; a null text is empty. Documents without words have no shingles and link with nothing.
Documents of any length are whole; repeated rows and ties share a node; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.llm.common import components, cut, drop_cut, strips, texts_of
from tidemark.llm.quality import text_bytes

SHINGLE, PERCENT, SEED = 5, 80, 7
#: Share of the range of hashes that the first pass counts; fragments of the order; documents of a first block, by what blocks grow, and rounds of spreading labels after each.
FIRST, FRAGMENTS, BLOCK, GROWTH, HOPS = 0.3, 8, 32, 64, 3
#: Up to so many documents to be read again are broadcast (8 bytes each); more are joined.
KEYS = 1 << 20
#: Longs of a set's parity bits.
PARITY = 4
LEAST = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the size is part of them."""
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ words[k : len(words) - size + 1 + k])
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted signed 64-bit hashes of the distinct shingles of a text."""
    digest, known = xxhash.xxh64_intdigest, {}
    held, found = np.zeros(0, np.uint64), []
    for strip in strips(text):
        words = strip.lower().split()
        for w in set(words):
            if w not in known:
                if len(known) > 1 << 16:
                    known.clear()
                known[w] = digest(w, SEED)
        h = np.array([known[w] if w in known else digest(w, SEED) for w in words], np.uint64)
        held = np.concatenate((held, h))
        if len(held) >= SHINGLE:
            found.append(np.unique(chained(held, SHINGLE)))
            held = held[len(held) - SHINGLE + 1 :]
            if len(found) > 16:
                found = [np.unique(np.concatenate(found))]
    if not found:
        found = [chained(held, len(held))] if len(held) else [held]
    return np.sort(np.unique(np.concatenate(found)).view(np.int64))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the hashes falls on each of 64 * ``PARITY`` bits. Two sets' parities differ in no more bits than the sets in members."""
    odd = np.bincount((hashes & (64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<i8").tobytes(), SEED) + LEAST


def spare(n: Column | str) -> Column:
    """n - ceil(0.8 n) + 1: so many shingles of a set of n can't all be missing in a set that links with it."""
    n = F.col(n) if isinstance(n, str) else n
    return n - F.ceil(n * PERCENT / 100.0) + 1


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def batches_of(arrays: list[np.ndarray], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about ``most`` hashes."""
    lo, held = 0, 0
    for i, a in enumerate(arrays):
        held += len(a)
        if held >= most:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(arrays):
        yield slice(lo, len(arrays))


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the row), n, node and ``first``, the hashes of the lowest ``FIRST`` of their range, of every row."""
    bound = LEAST + int(FIRST * 2**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in text_bytes(batch.column(2))]
            firsts = [s[: np.searchsorted(s, bound)] for s in sets]
            for part in batches_of(sets):
                some = sets[part]
                rows = slice(part.start, part.stop)
                lo, n = rows.start, rows.stop - rows.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([len(s) for s in some], pa.int64()), pa.array([node_of(s) if len(s) else None for s in some], pa.int64()), lists(firsts[part])], names=schema.names
                )

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    schema = keyed.select("doc_id", "key").schema.add("n", "long").add("node", "long").add("first", ArrayType(LongType()))
    return texts_of(keyed, "doc_id", "key", "text").mapInArrow(run, schema)


def whole_sets(texts: DataFrame) -> DataFrame:
    """node, n, ``bits`` (``parity``) and ``all``, the hashes of the whole set, of each of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in text_bytes(batch.column(0))]
            for part in batches_of(sets):
                some = sets[part]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in some], pa.int64()), pa.array([len(s) for s in some], pa.int64()), lists([parity(s) for s in some]), lists(some)], names=["node", "n", "bits", "all"])

    return texts_of(texts, "text").mapInArrow(run, "node long, n long, bits array<long>, all array<long>")


def survivors(docs: DataFrame, first: DataFrame) -> DataFrame:
    """A table (node, n, all) of the sets that may link, a row a set: those with too few n-grams of their own to be alone.

    Counts combine before they are shuffled, so an n-gram that all documents have is a row a task.
    """
    worded = first.where("node is not null")
    nodes = worded.groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    grams = worded.select(F.explode("first").alias("h"), "node").groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    own = grams.where("node = other").groupBy("node").agg(F.count("*").alias("own"))
    left = cut(nodes.join(own, "node", "left").na.fill(0, ["own"]).where(F.col("own") < spare("n")).select("key"), "left")
    few = left.limit(KEYS + 1).count() <= KEYS
    again = docs.select("text", F.xxhash64("doc_id", "text").alias("key")).join(F.broadcast(left) if few else left, "key", "left_semi")
    sets = cut(whole_sets(again.groupBy("key").agg(F.min("text").alias("text"))), "sets")
    drop_cut(left)
    return sets


def ordered(sets: DataFrame) -> tuple[DataFrame, Column]:
    """The sets that may still link (node, n, own, bits, grams that other sets have too in the global order), and the fragment of an n-gram (count, h)."""
    counts = cut(sets.select(F.explode("all").alias("h"), "node").groupBy("h").agg(F.count("*").alias("count"), F.min("node").alias("node")).select(F.when(F.col("count") > 1, F.col("h")).alias("h"), "count", F.when(F.col("count") == 1, F.col("node")).alias("node")), "counts")
    own = counts.where("count = 1").groupBy("node").agg(F.count("*").alias("own"))
    nodes = cut(sets.select("node", "n").join(own, "node", "left").na.fill(0, ["own"]).where(F.col("own") < spare("n")), "nodes")
    shared = counts.where("count > 1").select("h", "count")
    at = F.col("count") + F.col("h") / 2.0**64 + 0.5  # a place in the order, to a double's precision
    fragment = F.lit(0)
    for pivot in shared.select(at.alias("at")).approxQuantile("at", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 0.01):
        fragment = fragment + (at > pivot).cast("int")
    rows = sets.join(nodes.select("node", "own"), "node").select("node", "n", "own", "bits", F.explode("all").alias("h"))
    placed = rows.join(shared, "h").groupBy("node", "n", "own", "bits").agg(F.array_sort(F.collect_list(F.struct("count", "h"))).alias("grams"))
    out = cut(placed, "ordered")
    for old in (counts, nodes):
        drop_cut(old)
    return out, fragment


def segments(sets: DataFrame, fragment: Column) -> DataFrame:
    """node, fragment and the hashes of each set's segment, for n-grams that some other set has too."""
    return sets.select("node", F.explode("grams").alias("g")).select("node", F.col("g.count").alias("count"), F.col("g.h").alias("h")).groupBy("node", fragment.alias("fragment")).agg(F.collect_list("h").alias("hashes"))


def meetings(sets: DataFrame) -> DataFrame:
    """h, node, n, own, bits and place (from 0, in the order) of the n-grams in which a linking pair must meet."""
    room = F.greatest(spare("n") - F.col("own"), F.lit(0)).cast("int")
    heads = sets.select("node", "n", "own", "bits", F.posexplode(F.slice("grams", F.lit(1), room)).alias("at", "g"))
    return heads.select(F.col("g.h").alias("h"), "node", "n", "own", "bits", (F.col("own") + F.col("at")).alias("place"))


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, total: both sizes) that link: overlaps counted by fragment, then summed by pair."""
    left = pairs.join(parts.select(F.col("node").alias("a"), "fragment", F.col("hashes").alias("_a")), "a")
    both = left.join(parts.select(F.col("node").alias("b"), "fragment", F.col("hashes").alias("_b")), ["b", "fragment"])
    partial = both.select("a", "b", "total", F.size(F.array_intersect("_a", "_b")).alias("part"))
    overlap = F.sum("part")
    return partial.groupBy("a", "b", "total").agg(overlap.alias("overlap")).where(F.col("overlap") * 100 >= (F.col("total") - F.col("overlap")) * PERCENT).select("a", "b")


def spread_labels(links: DataFrame) -> DataFrame:
    """node and component for nodes with links: the smallest node within ``HOPS`` + 1 links, which in a dense group is one for all.

    It is only used to leave out pairs, so that long chains may still have several.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(HOPS):
        there = both.join(labels.select(F.col("a").alias("b"), "component"), "b").select("a", "component")
        after = cut(there.unionByName(labels.select("a", "component")).groupBy("a").agg(F.min("component").alias("component")), "labels")
        drop_cut(labels)
        labels = after
    drop_cut(both)
    return labels.select(F.col("a").alias("node"), "component")


MET = ["node", "n", "place", "bits"]


def may_link() -> Column:
    """Whether x and y leave room for the overlap: by size, by what is left of both in the order, and by parity, as linking sets differ in at most a ninth of their members."""
    total, room = F.col("x_n") + F.col("y_n"), F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    differ = sum((F.bit_count(F.col("x_bits")[k].bitwiseXOR(F.col("y_bits")[k])) for k in range(PARITY)), F.lit(0))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * PERCENT) & (room * (100 + PERCENT) >= total * PERCENT) & (differ * (100 + PERCENT) <= total * (100 - PERCENT))


def as_side(side: str, rows: DataFrame, keys: tuple[str, ...] = ("h", "share")) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keys])


def pairs_of(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, total: both sizes)."""
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), (F.col("x_n") + F.col("y_n")).alias("total")).distinct()


def jaccard_links(sets: DataFrame, fragment: Column) -> DataFrame:
    """node and component of all sets that link; rounds of pairs until each n-gram's documents are connected or have all met."""
    met = cut(meetings(sets), "met")
    hub = F.min(F.struct("own", *MET)).alias("hub")
    sizes = cut(met.groupBy("h").agg(F.count("*").alias("m"), hub).where("m > 1"), "sizes")
    rows = cut(met.drop("own").join(sizes.select("h", "m"), "h"), "rows")
    parts = cut(segments(sets, fragment), "segments")
    most = sizes.agg(F.max("m")).first()[0] or 0
    drop_cut(met)
    # blocks of about so many members: as many blocks as a power of two; those of a round before lie inside them
    share = lambda size: F.pmod(F.xxhash64("node"), F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("m") / F.lit(float(size)))), F.lit(0))).cast("long"))
    first = rows.select("h", *MET, share(BLOCK).alias("share"))
    near = as_side("x", first).join(as_side("y", first), ["h", "share"]).where((F.col("x_node") < F.col("y_node")) & may_link())
    hubs = sizes.where(F.col("m") > BLOCK).select("h", *[F.col(f"hub.{c}").alias(f"y_{c}") for c in MET])
    central = as_side("x", rows.select("h", *MET), ("h",)).join(hubs, "h").where((F.col("x_node") != F.col("y_node")) & may_link())
    pairs = cut(pairs_of(near).unionByName(pairs_of(central)).distinct(), "pairs")
    drop_cut(sizes)
    links = [cut(verified(pairs, parts), "links")]
    tried, old = [pairs], []
    whole = lambda tables: reduce(DataFrame.unionByName, [t.select("a", "b") for t in tables])
    before, block = BLOCK, BLOCK * GROWTH
    while before < most:
        found = spread_labels(whole(links))
        labelled = cut(rows.where(F.col("m") > before).join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
        groups = cut(labelled.groupBy("h", "component").agg(F.count("*").alias("k")), "groups")
        main = cut(groups.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("h", "main"), "main")
        old += [labelled, groups, main]
        if main.isEmpty():  # all that meet are connected
            break
        own = cut(labelled.join(main, "h").select("h", *MET, "component", "main", share(block).alias("share"), share(before).alias("was")), "open")
        outside = as_side("x", own.where("component <> main")).join(as_side("y", own), ["h", "share"])
        some = outside.where((F.col("x_component") != F.col("y_component")) & (F.col("x_was") != F.col("y_was")) & may_link())
        pairs = cut(pairs_of(some).join(whole(tried), ["a", "b"], "left_anti"), "pairs")
        links.append(cut(verified(pairs, parts), "links"))
        tried.append(pairs)
        old.append(own)
        before, block = block, block * GROWTH
    out = components(whole(links))
    for table in (*old, *tried, rows, parts):
        drop_cut(table)
    return out


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included; rows without a doc_id count for nothing but their own links.
    """
    first = cut(summaries(docs), "summaries")
    members = cut(first.select("doc_id", "n", "node"), "members")
    sets, fragment = ordered(survivors(docs, first))
    drop_cut(first)
    found = jaccard_links(sets, fragment)
    named = cut(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    whole = cut(named.join(least, "component").select("node", "component_id"), "whole")
    out = members.where("node is not null").join(whole, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(members.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_sql() -> str:
    """All pairs that share a shingle, and components by repeated spreading of the smallest id."""
    return f"""WITH RECURSIVE worded AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        shingled AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS s FROM worded),
        sizes AS MATERIALIZED (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingled s ON s.doc_id = d.doc_id GROUP BY 1),
        links AS MATERIALIZED (SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) o JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
        edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT doc_id AS a, doc_id AS r FROM sizes UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.a WHERE reach.r < e.b)
        SELECT doc_id, n AS n_shingles, m AS component_id FROM sizes JOIN (SELECT a, min(r) AS m FROM reach GROUP BY 1) g ON g.a = doc_id"""
