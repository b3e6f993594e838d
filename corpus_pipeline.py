"""The corpus pipeline. Every stage works on all that its predecessor kept, written and read again.

Stages: quality rules (rejected documents go, frequent lines are cut), exact deduplication (one document of equal texts stays),
near-duplicate detection (one document of each group stays), substring deduplication (repeated passages are cut, documents
without a word left go), packing (pieces of token sequences). All but the last return the columns of ``documents``; n_chars
follows the text. An empty table runs through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceframe.llm import exact_dedup, near_dedup, packing, quality_rules, queries, substring_dedup
from traceframe.llm.folders import scratch


#: Percent of Jaccard similarity from which documents are near copies in the pipeline.
SIMILARITY = 80


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(quality_rules.clean(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, threshold=SIMILARITY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(substring_dedup.clean(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", pack)]
#: Sketches, rolling hashes and tokenisation have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
