"""A corpus pipeline: quality, near-duplicates, benchmark leaks, tokens. Each stage is one of the operators of corvane.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, quality, simhash, tiling
from corvane.llm.common import read, staged, unstage
from corvane.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labels selects."""
    return quality.keep_selected(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard similarity 0.8)."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is tiled into."""
    return tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of what is left, with their digests."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

#: No stage but the last could be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
