"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage reads what its predecessor wrote. All but the last keep the columns of documents; the
mixing stage may repeat rows, the last adds shard_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import Scratch, discarded, read_table
from postmill.llm.decontaminate import decontaminate_stage
from postmill.llm.mixing import mixing_stage
from postmill.llm.near_dedup import dedup_stage
from postmill.llm.sharding import shard_stage
from postmill.llm.toxicity import toxicity_stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity_stage(spark, docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return dedup_stage(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate_stage(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated to flatter weights."""
    return mixing_stage(spark, docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as read back from compacted shards, with the shard of each."""
    return shard_stage(spark, docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: Trained scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again; what a stage kept for itself is then deleted."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with discarded(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
