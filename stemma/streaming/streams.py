"""Structured Streaming forms of the incremental operators: all that is there now is read, then the query ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def shared(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    return f"{shared_folder(spark)}/stemma-stream/{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the table at path, which is a folder of files or one file."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if place.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run(stream: DataFrame, mode: str, write) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{shared(stream.sparkSession)}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def hourly(spark: SparkSession, path: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by hour and type, with a watermark; windows are written as they change."""
    out = f"{shared(spark)}/hourly"
    events = read(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
    run(rows, "update", lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    found = spark.read.schema("window_start timestamp_ntz, event_type string, n long, total double, batch int").parquet(out)
    return found.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def ingest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows as they arrive, each key once; a batch that is tried again replaces what it wrote.

    Keys are told apart against what is written, by a join, so that the stream itself keeps no state.
    """
    out = f"{shared(spark)}/ingest"
    rows = read(spark, path)

    def write(df: DataFrame, batch: int) -> None:
        new = df.dropDuplicates([key])
        if batch:
            written = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(*[f"{out}/batch={b}" for b in range(batch)])
            new = new.join(written.select(key), key, "left_anti").select(df.columns)
        new.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    run(rows, "append", write)
    return spark.read.parquet(out).drop("batch")
