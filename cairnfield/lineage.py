"""Cutting lineage in loops: checkpoints in the folder that all executors share; tables that live as long as a query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one stands in where it isn't set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairnfield-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def workshop(spark: SparkSession) -> Iterator[str]:
    """A new folder below the shared one, deleted at the end; results that read it must be cut before."""
    path = f"{shared(spark)}/workshop-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
