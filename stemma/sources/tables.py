"""Tables and the adaptations by which the operators apply to them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with every column of schema: absent ones are null, present ones are cast; further ones go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Reference edges (citing, cited): an order cites each part it holds, once."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).distinct()


def follow_ups(spark: SparkSession, folder: str, back: int = 3) -> DataFrame:
    """Citations (citing, cited) among orders: an order cites the customer's `back` orders before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    earlier = F.array(*[F.lag("o_orderkey", k).over(w) for k in range(1, back + 1)])
    listed = table(spark, folder, "orders").select(F.col("o_orderkey").alias("citing"), earlier.alias("earlier"))
    return listed.select("citing", F.explode("earlier").alias("cited")).filter("cited is not null")


#: The same edges in SQL.
BASKETS_SQL = "basket AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem)"
FOLLOW_SQL = "ranked AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), follow AS (SELECT a.o_orderkey AS citing, b.o_orderkey AS cited FROM ranked a JOIN ranked b ON a.o_custkey = b.o_custkey AND b.n BETWEEN a.n - 3 AND a.n - 1)"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stemma-")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Iterative jobs cut their lineage with checkpoint(), in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def staged(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
