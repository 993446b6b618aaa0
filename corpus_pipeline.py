"""A corpus in five stages: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. A stage's scratch
tables go when its output is written, and a stage's output goes when the next one's is; the last one's stays.

Defined results: null and empty texts have no words and fall to the quality rules; rows that share a doc_id are judged each by
quality rules and line dedup, and stay or go together in near-dedup; equal rows are treated alike and each stays until
near-dedup, which keeps all rows of the document with the smallest id; rows without a doc_id pass quality rules by their text, lose no
line, are no one's duplicate, are mixed and encoded like others; any long is a doc_id; a table without n_chars goes without it; null sources mix as a source of their own; an empty
table gives an empty result at every stage; columns other than doc_id, text, source and n_chars pass through until the last
stage, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, common, linededup, mixing, neardup, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is under one half, or that fail the base rule, go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents stay, with n_chars of what is left."""
    kept = linededup.rebuild(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more, the smallest doc_id."""
    return neardup.keep_one(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' tokens, with a digest of the ids and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), form="digest")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode)]

#: Near-duplicates, hashes and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with common.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
