"""The corpus pipeline: every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.llm import exact_dedup, near_dedup, packing, quality, toxicity
from quiver.llm.common import documents, saved

#: The stage's own contract, looser than op10's: sets of five words with a similarity of 0.8 or more are linked. A pair at
#: exactly 0.8 agrees in fewer than 32 of 64 coordinates with a chance of 2.0e-8.
NEAR_WORDS, NEAR_SHARE, NEAR_MATCH = 5, (80, 100), 32


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of whose windows the toxicity network sees toxic language."""
    return toxicity.accepted(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one with the largest id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the smallest id."""
    return near_dedup.keep_one(docs, words=NEAR_WORDS, share=NEAR_SHARE, match=NEAR_MATCH)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("exact_dedup", exact_stage),
          ("near_dedup", near_stage), ("packing", packing_stage)]

#: Trained classifiers can't be written in SQL; tests/llm/test_pipeline.py checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
