"""Folders that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a session in one process may do without."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="shared-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """The path as the driver opens it; a bundle of single files needs a shared folder that is mounted."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is not mounted on the driver")
    return path.removeprefix("file://").removeprefix("file:")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to a new path in the shared folder and read again: what reads them twice reads the same rows, which are worked out once."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def held(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """As `kept`, for a block, after which what was written is deleted.

    Unlike a persisted table, whose whole plan is part of every later plan and of all that the driver records of it, what is read again is one scan.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
