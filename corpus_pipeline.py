"""Corpus pipeline: quality filter, near-duplicates, repeated spans, benchmark leaks, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echoledger.llm import bpe, decontaminate, neardup, quality, suffixes
from echoledger.llm.shared import Tables

#: Least score of a document that stays.
LEAST_QUALITY = 0.5
#: Bytes of a repeated string: passages of fifty words are longer in every language with a space between words.
REPEAT_BYTES = 200
#: Vocabulary file of the last stage.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_documents(docs, quality.fit(docs, labels), LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def repeated_span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in several places."""
    return suffixes.strip_repeats(docs, REPEAT_BYTES)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the text decoded from them."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_span_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the written table of the one before."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            tables.drop(before)
        before = docs
    return docs


#: The classifier is trained, so that no SQL gives these rows; a test compares the stages after it with brute force.
ORACLE_SQL = None
