"""The corpus pipeline: documents go through STAGES in order; each stage is written as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echograms.llm.decontamination import drop_contaminated
from echograms.llm.language_id import keep_identified, trained_on
from echograms.llm.mixing import mixed_rows
from echograms.llm.near_duplicates import keep_one_each
from echograms.llm.packing import packed_ids
from echograms.llm.runtime import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell."""
    return keep_identified(docs, trained_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of at least 0.8."""
    return keep_one_each(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards."""
    return mixed_rows(docs).drop("shard")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packed_ids(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
ORACLE_SQL = None  # the stages that learn, hash and pack cannot be stated in SQL; tests/llm/test_pipeline.py checks them by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
