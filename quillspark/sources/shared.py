"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster fails."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return f"{found if ':' in found else 'file://' + found}/{name}-{uuid.uuid4().hex}"


#: Shuffles of a query go from the executors' disks when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new shared folder: what reads it several times doesn't work it out again, and its shuffles leave the disks."""
    path = shared_folder(df.sparkSession, name)
    write_cleanly(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_cleanly(df: DataFrame, path: str) -> None:
    """Writes a new table, and removes the shuffles that were made for it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        conf.set(CLEANUP, before)
