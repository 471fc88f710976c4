"""Cutting a plan's lineage between rounds of an iteration, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: rows that are broadcast at most.
LIGHT = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a session on one machine gets one of its own, and a cluster is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="umbraloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The rows as a Parquet table in the shared folder, which takes less room than `cut` and is deleted at the end: what is read from it later has to be cut before."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(at)
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A cut table, marked for broadcast if it has LIGHT rows at most."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= LIGHT else df
