"""What the operators have in common: the shared folder, written intermediate tables, and batches of text for Python."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of text that are held as Python strings at once; an Arrow batch may hold many more.
SLICE_ROWS = 256
#: Characters after which a slice ends early, so that a run of very long texts stays small in memory.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch, and where Spark keeps that number.
BATCH_ROWS, BATCH_SETTING, DEFAULT_BATCH = 500, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Whether Spark deletes a query's shuffle files when the query has ended.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own if the session runs in one process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{LOCAL_CHECKPOINTS}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted when the driver's JVM ends, if nobody has done so before."""
    path = f"{shared_dir(spark)}/lorescape/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes one intermediate table early."""
    files, where = _file_system(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Scratch:
    """Intermediate tables of one call, which are dropped at its end: with Scratch() as temporary: ... temporary.saved(df, name)."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.made:
            drop_path(spark, path)
        self.made = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.made.append((df.sparkSession, path))
        return out

    def drop(self, count: int = 1) -> None:
        """Drops the oldest tables early."""
        for spark, path in self.made[:count]:
            drop_path(spark, path)
        del self.made[:count]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors, and lets AQE split skew.

    The table stays until the driver's JVM ends; Scratch.saved() is for those that a call doesn't return.
    """
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table needs no shuffle files of its query any more, so Spark is asked to delete them at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before) if before is not None else spark.conf.unset(CLEANUP_SETTING)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS instead of Spark's default of 10,000, which are tens of MB of text on both sides of the pipe.

    A number that the session has set otherwise stays.
    """
    if spark.conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds at most SLICE_ROWS rows and about SLICE_BYTES of the text column."""
    for batch in batches:
        column = batch.column(text)
        at, n = 0, batch.num_rows
        while at < n:
            size, to = 0, at
            while to < n and to - at < SLICE_ROWS and (to == at or size < SLICE_BYTES):
                size += len(column[to].as_buffer() or b"") if column[to].is_valid else 0
                to += 1
            yield batch.slice(at, to - at)
            at = to


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[list, list], dict]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs a function over slices of (keys, texts) on the executors; null texts are passed as empty strings.

    make is called once for a task and returns the function, which returns a dict of columns of equal length.
    """
    small_batches(df.sparkSession)
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, text):
            columns = work(part.column(key).to_pylist(), [x or "" for x in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return df.select(key, text).mapInArrow(run, schema)


def per_slice(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Runs a function over slices of whole rows; what it returns has the same columns. Output leaves in slices, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, text):
            yield work(part)
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
