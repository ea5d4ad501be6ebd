"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage works on all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, mixing, near_dedup, quality, sharding
from stemma.llm.common import stage

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the line labels reject go; repeated rows are judged alike, null ids are no hindrance."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the least id (null ids last); of rows with that id, one; rows without words all stay."""
    return near_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; null items and texts hold none, repeated rows are judged alike."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, rows of one id are taken together."""
    return mixing.apply_mix(docs, F.array("source"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes; rows of one id, and those with null, go to one shard and have slots of their own."""
    return sharding.assign_shards(docs, sharding.HashTree.uniform(SHARDS))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]

#: The line labels of the first stage come from a trained chain, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
