"""The corpus pipeline: five stages over documents, each written as Parquet and read back as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents:
language ID drops documents of no identified language and sets lang; the n-gram join leaves one document of each group of
near copies; decontamination drops documents that overlap a benchmark item; secret scans replace secrets in the texts;
packing returns the pieces of the packed sequences. The result can't be written in SQL (a trained model, a tokenizer), so
tests/llm checks the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import decontamination, language_id, ngram_join, packing, secret_scan
from sketchloom.llm.staging import released, small_batches, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # whole texts go through Python
        return written(decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark")), "pipeline-decontamination")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return written(secret_scan.redact(docs), "pipeline-secret-scan")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, size=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        if "staged_path" not in out.__dict__:
            out = written(out, f"pipeline-{name}")
        released(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
