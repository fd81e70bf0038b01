"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidemark.llm.ann import nearest
from tidemark.llm.codebooks import op11_sql, vector_codes, with_label_error
from tidemark.llm.common import crc_of_id, shared_dir, table
from tidemark.llm.decontam import contaminated
from tidemark.llm.html import extract
from tidemark.llm.jaccard import jaccard_groups, op12_sql
from tidemark.llm.licenses import scan, scan_sql
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.quality import score_quality, train_quality
from tidemark.llm.sharding import shard_by_bytes
from tidemark.llm.simhash import hex_of, near_groups
from tidemark.llm.token_files import digests, read_token_files, with_starts, write_token_files
from tidemark.llm.toxicity import score_toxicity, train_toxicity
from tidemark.llm.tries import op13_sql, trie

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), TOKENIZER)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest, ["doc_id", "piece"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return with_starts(digests(read_token_files(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = with_label_error(vector_codes(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_sharding": op6_sharding,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_neighbours": op9_neighbours,
    "op10_decontamination": op10_decontamination,
    "op11_codebooks": op11_codebooks,
    "op12_jaccard": op12_jaccard,
    "op13_tries": op13_tries,
}
ORACLES: dict[str, str] = {"op5_licenses": scan_sql(), "op11_codebooks": op11_sql(), "op12_jaccard": op12_sql(), "op13_tries": op13_sql()}
