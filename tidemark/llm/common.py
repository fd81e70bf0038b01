"""Helpers shared by the training-data operators: table access, materialised cuts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may leave it unset; a private folder then stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, keep: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{keep}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; only for tables that nothing reads any more."""
    drop_path(df.sparkSession, df._cut_path)


#: Bytes of an Arrow batch; Spark's own limit is 10,000 rows, whatever their size.
BATCH_BYTES = "4m"


def texts_of(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` for Python, with batches of bounded bytes, so that long texts don't fill a worker."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.select(*columns)


#: Bytes of a text whose words are held at once, and the bytes that part words.
STRIP, BLANKS = 1 << 20, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def strips(text: bytes, size: int = STRIP) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b, at, at + size) for b in BLANKS)
        if end < at:  # one word longer than a strip
            end = min((e for e in (text.find(b, at + size) for b in BLANKS) if e >= 0), default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Bytes of text that a model is fitted on at most, in all and of one text.
SAMPLE_BYTES, SAMPLE_TEXT = 64 << 20, 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs of ``SAMPLE_BYTES`` in all for fitting, chosen by a hash of the id among ``keep``.

    The ids are picked from the narrow label table first, so that only the texts of the
    sample leave the scan of ``docs``. Texts over ``SAMPLE_TEXT`` bytes aren't fitted on (they are scored
    like any other); of several texts of one id the first in order is. ``rows`` and the bytes bound what reaches the driver.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
        .select("doc_id", F.col(label).cast("int").alias("_y"))
        .groupBy("doc_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
        .where(F.octet_length("_t") <= SAMPLE_TEXT)
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "_y")
        .agg(F.min("_t").alias("_t"))
        .withColumn("_h", F.xxhash64("doc_id"))
        .withColumn("_sum", F.sum(F.octet_length("_t")).over(order))  # over ``rows`` rows
        .where(F.col("_sum") <= SAMPLE_BYTES)
        .select("_t", "_y")
        .toArrow()
    )
    return list(zip(found["_t"].to_pylist(), found["_y"].to_pylist(), strict=True))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) per node that has a link.

    ``component`` is the smallest node reachable. Rounds of large-star and small-star
    contraction; each one is cut to the shared folder. Both joins read written tables, so
    that a node with very many links is split over tasks at run time.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # large star: every larger neighbour points at the smallest node around
        large = cut(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: every smaller neighbour, and the node itself, point at the smallest
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct(), "links")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        for old in (edges, low, large, least):
            drop_cut(old)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
