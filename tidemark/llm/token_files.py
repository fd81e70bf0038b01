"""Token ids as Parquet list columns: ordered files, controlled row groups and page indexes.

Documents are range-partitioned on doc_id, sorted, encoded and written by Spark's Parquet
writer, one row a document: doc_id, n_tokens and the list ``tokens``. Small row groups and
pages, with the page indexes the writer adds, let a reader fetch a range of doc_id, or the
metadata columns alone, without the rest. Ids are dictionary- or delta-encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.common import cut, texts_of
from tidemark.llm.tokens import ended

ROW_GROUP, PAGE, END_ID = 16 << 20, 128 << 10, 0
#: Bytes of text that go to one file.
FILE_BYTES = 256 << 20


def token_lists(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and tokens (with ``end_id`` last) of every row; a null text counts as empty."""
    ids = docs.select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = ended(batch.column(1), path, end_id)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int32()), lists], names=["doc_id", "n_tokens", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, ids.schema.add("n_tokens", "integer").add("tokens", ArrayType(IntegerType())))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, delta: bool = True) -> None:
    """Write the token lists of ``docs`` to ``path`` in ascending doc_id order (nulls first), over file after file.

    There is a file for each ``FILE_BYTES`` of text, and no fewer than shuffle partitions. Rows of one doc_id stand in the order of a hash of their text, so
    that a doc_id that a third of all rows have is dealt over many files.
    """
    spark = docs.sparkSession
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    order = ("doc_id", F.xxhash64("text"))
    ordered = texts_of(docs, "doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = token_lists(ordered, tokenizer, end_id).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("maxRecordsPerFile", 0)  # one file a partition: starts are summed by file
    # version 2 pages hold integers as binary-packed deltas where a dictionary isn't used
    (writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false") if delta else writer).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, tokens, ``file``, the number of the file in doc_id order, and ``row``, the place in it."""
    rows = spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("row"))


def digests(tokens: DataFrame) -> DataFrame:
    """The rows of ``read_token_files`` with ids_crc32 (over little-endian 32-bit ids) instead of the lists; written, as they are read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    made = texts_of(tokens, "file", "row", "doc_id", "n_tokens", "tokens").mapInArrow(run, "file long, row long, doc_id long, n_tokens int, ids_crc32 long")
    return cut(made.withColumn("n_tokens", F.col("n_tokens").cast("long")), "digests")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (file, row, n_tokens, ...) with ``start``: the ids before each, over all files, in the order of the files' rows.

    Sums by file are one row a file; only these are summed up in one place.
    """
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = files.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return inside.join(before, "file").withColumn("start", (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in")
