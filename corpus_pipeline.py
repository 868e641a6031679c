"""A cleaning pipeline over documents: a list of named stages, each written and read again before the next.

Stages handle null ids, texts and columns, empty tables and extra columns as the operators they call say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, quality, queries, store, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the rules go, whatever their ids."""
    rows, key = store.keyed(docs, store.Scratch(spark, "quality_stage"))
    failed = quality.assess(rows, id=key).filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return rows.join(failed, key, "left_anti").drop(key)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on those still there, calls toxic go."""
    return toxicity.keep_clean(docs, queries.toxicity_chain(spark, sf_dir, docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five words, similarity of 0.8 or more."""
    return jaccard.keep_one(docs, size=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return queries.packed(docs)


STAGES: list = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = store.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
