"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import decontam, quality, simhash, toxicity
from tidemark.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    labels, bench = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality":
            want = quality.score_quality(docs, quality.train_quality(docs, labels)).where("score >= 0.5")
        elif name == "toxicity":
            want = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).where("score < 0.5")
        elif name == "near_dedup":
            want = simhash.near_groups(docs).where("doc_id = component_id")
        elif name == "decontamination":
            want = docs.join(decontam.contaminated(docs, bench), "doc_id", "left_anti")
        else:
            want = docs
            assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()
        assert ids == {r["doc_id"] for r in want.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert 0 < docs.count()
