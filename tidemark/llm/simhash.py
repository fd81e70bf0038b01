"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Half the radius is one bit
with one bit left over. The bits are cut into ``MASKS`` blocks, and for each block a
fingerprint emits, on the other bits, all variants within one bit. If two fingerprints
differ in one to three bits, some block holds at least one of these; on the bits outside it
they differ in two at most and so share a variant. The fingerprints are shuffled on the
variants, and those that meet are compared on all 64 bits. Each one emits
``MASKS + 2 * 64`` variants instead of the 2,081 within two bits of it, with no link lost.

Equal fingerprints are one node before any variant is made, so a third of all rows may be
copies of one text. Inside a bucket a search over the members not yet reached finds which
belong together, and one link per member is emitted, never all pairs. A bucket's members are distinct
fingerprints that agree on 42 or more bits, so few texts but adversarial ones share one, and dense buckets link at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, drop_cut, strips, texts_of
from tidemark.llm.quality import text_bytes

RADIUS, MASKS, SHINGLE, SEED = 3, 3, 3, 42


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text: bits set in over half of its shingles' hashes. Words are held a strip at a time, whatever the length."""
    digest, ones, n, held = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    for strip in strips(text):
        words = held + strip.lower().split()  # bytes: ASCII letters, and white space 0x20 and 0x09 to 0x0D
        held = words[1 - SHINGLE :]
        if len(words) >= SHINGLE:
            joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
            h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)], dtype="<u8")
            n += len(h)
            for lo in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n:
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select("doc_id")
    return texts_of(docs, "doc_id", "text").mapInArrow(run, ids.schema.add("fp", "long"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_table() -> list[tuple[int, int]]:
    """(bits to keep, bits to flip and set) of each variant; a block's own bits are set, to tell blocks apart."""
    out, edges = [], [round(64 * k / MASKS) for k in range(MASKS + 1)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        block = ((1 << (hi - lo)) - 1) << lo
        keep = (1 << 64) - 1 - block
        out += [(signed(keep), signed(block | flip)) for flip in [0, *(1 << i for i in range(64) if keep >> i & 1)]]
    return out


def linked(members: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member of its group) for the groups that links within ``members`` make."""
    rest, out = np.unique(members), []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= RADIUS
            found, rest = rest[near], rest[~near]
            queue.extend(found)
            out += [(int(x), int(root)) for x in found]
    return out


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys; rows come sorted by key. The last run waits for the next batch."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        two = first[size == 2]
        a, b = f[two], f[two + 1]
        near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
        pairs = [x for at, n in zip(first[size > 2], size[size > 2], strict=True) for x in linked(f[at : at + n])]
        more = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        both = np.unique(np.concatenate((np.stack((a[near], b[near]), axis=1), more)), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        k = np.concatenate((held_k, batch.column(0).to_numpy()))
        f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
        last = np.searchsorted(k, k[-1]) if len(k) else 0
        held_k, held_f = k[last:], f[last:]
        if last:
            yield links(k[:last], f[:last])
    if len(held_k):
        yield links(held_k, held_f)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, enough to give the groups that all links give."""
    variants = F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(x).alias("flip")) for k, x in variant_table()])
    keyed = fps.select("fp", F.explode(variants).alias("v")).select(F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Rows
    without words have fingerprint zero and link like any other; repeated rows and ties share
    a fingerprint; extra columns are ignored; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    links = cut(near_links(reps.select("fp")).distinct(), "near")
    found = components(links.select("a", "b"))
    members = cut(found.join(reps, F.col("node") == F.col("fp")).select("fp", "component", "rep"), "members")
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut(members.join(least, "component").select("fp", "component_id"), "named")
    whole = cut(reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "groups")
    for old in (links, members, named, reps):
        drop_cut(old)
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def dedup_near(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest doc_id.

    Rows of one doc_id count as one document, of which the row with the smallest text (null first) stays; rows without a doc_id can't be told apart and are all kept.
    """
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    keep = cut(near_groups(docs).where("doc_id = component_id").groupBy("doc_id").count(), "kept")
    if not keep.where("count > 1").isEmpty():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        docs = docs.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("_row")).select("doc_id", "_row.*").select(docs.columns)
    return docs.join(keep.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns).unionByName(nameless)
