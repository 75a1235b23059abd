"""Results that are used more than once and have to be the same each time, whatever becomes of the executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where driver and executors are one process and the session names no folder, as in tests.
LOCAL = "file:///tmp/checkpoints"


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL).rstrip("/")


def folder(spark: SparkSession) -> tuple[str, object, object]:
    """A new folder in the shared one, with its file system and path; it is deleted when the driver's JVM ends."""
    path = f"{_folder(spark)}/lorescape/rows-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path, files, where


def _written(df: DataFrame) -> tuple[DataFrame, object, object]:
    spark = df.sparkSession
    path, files, where = folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), files, where


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder that spark.checkpoint.dir names; they stay until the driver's JVM ends."""
    return _written(df)[0]


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """The rows, written likewise, for as long as the context lasts."""
    rows, files, where = _written(df)
    try:
        yield rows
    finally:
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


class Kept:
    """The rows, written likewise, until their owner drops them."""

    def __init__(self, df: DataFrame):
        self.rows, self._files, self._where = _written(df)

    def drop(self) -> None:
        self._files.delete(self._where, True)
        self._files.cancelDeleteOnExit(self._where)
