"""What the operators of this subpackage share: scratch tables in the shared folder, shipping code, text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters, as bytes.split() cuts them.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch, where an application names no bound. Spark's own is 64 MB, and a task holds several copies on both sides.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage in a way that survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/stemma/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that functions in it need no installation there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="stemma-ship-"), "stemma.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("stemma", os.path.relpath(os.path.join(folder, name), top)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session are bounded by BATCH_BYTES, if the application does not say otherwise."""
    if spark.sparkContext.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, so that extra columns of the input never clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash01(*parts: Column) -> Column:
    """A number in (0, 1) from md5, which other engines can compute alike: 52 bits, centred."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def text_bytes(value) -> bytes:
    return b"" if value is None else value.encode()


def segments(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array, with its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
