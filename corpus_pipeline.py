"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept, as written to Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import common, stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.quality_stage(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.near_duplicate_stage(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.substring_stage(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixing_stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packing_stage(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]
#: Components, substring cuts and balanced sampling cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = common.written(stage(spark, docs, sf_dir))
        if before:
            common.discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
