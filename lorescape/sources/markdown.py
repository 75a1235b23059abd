"""Markdown files as a table: found below a root, read as UTF-8, parsed; files that can't be read go to a table of failures."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.functions.markdown import parsed, title_case
from lorescape.functions.text import stem

#: Folders of other people's files; fixed values.
VENDORED = ("venv", "node_modules", "__pycache__")
#: Levels of folders that are dealt to tasks, and bytes of files that a task holds at once.
FANNED, BATCH_BYTES = 2, 8 << 20
WALKED = "path string, mtime double, folder boolean"


def included(relative):
    """Paths none of whose parts is hidden or vendored."""
    return ~F.exists(F.split(relative, "/"), lambda p: F.startswith(p, F.lit(".")) | p.isin(*VENDORED))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, mtime, content) of the Markdown files below a root; hidden and vendored folders are left out.

    A local root is made canonical first (~, .. and links), and so are files that are links, so that a file has one path however it is
    spelled; links that lead out of the root, and links to folders, are left out. Roots with a scheme are read by Spark, with its own
    settings for that file system; Spark doesn't see names there that begin with "_".
    """
    return read_contents(listing(spark, root))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """The same without contents, for a local root; no file is opened. For others with contents, which Spark reads only if they are asked for."""
    base = canonical(root)
    top = base.removeprefix("file://")
    if "://" in top:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
        relative = F.substring("path", len(base) + 2, 1 << 30)
        return rows.select("path", relative.alias("relative"), F.col("modificationTime").cast("double").alias("mtime"), "content").where(included(F.col("relative")))
    found = spark.createDataFrame([(top, 0.0, True)], WALKED)
    for levels in [1] * FANNED + [None]:  # the first levels one by one, so that their folders are dealt to tasks, which go down from there
        found = found.mapInArrow(partial(_walked, levels=levels), WALKED)
        found = found.repartition("path") if levels else found
    walked = found.where("not folder").mapInArrow(partial(_resolved, top=top), "path string, relative string, mtime double")
    return walked.groupBy("path").agg(F.min("relative").alias("relative"), F.max("mtime").alias("mtime"))


def canonical(root: str) -> str:
    """A root without a slash at its end; a local one without ~, .. and symbolic links."""
    local = root.removeprefix("file://") if root.startswith("file://") else root
    if "://" in local:
        return root.rstrip("/")
    return root[: len(root) - len(local)] + os.path.realpath(os.path.expanduser(local))


def _walked(batches: Iterator[pa.RecordBatch], levels: int | None) -> Iterator[pa.RecordBatch]:
    """Puts what folders hold in their place, down to so many levels; files pass."""
    for b in batches:
        out = []
        todo = [(p, 0) for p, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist(), strict=True) if folder]
        while todo:
            at, depth = todo.pop()
            if depth == levels:
                out.append((at, 0.0, True))
                continue
            try:
                with os.scandir(at) as entries:
                    for e in entries:
                        if e.name.startswith(".") or e.name in VENDORED:
                            continue
                        if e.is_dir(follow_symlinks=False):
                            todo.append((e.path, depth + 1))
                        elif e.name.endswith(".md") and e.is_file():
                            out.append((e.path, e.stat().st_mtime, False))
            except FileNotFoundError:
                continue  # gone since its folder was listed
        yield b.filter(pc.invert(b.column("folder")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], b.schema.field(i).type) for i in range(3)], names=b.schema.names)


def _resolved(batches: Iterator[pa.RecordBatch], top: str) -> Iterator[pa.RecordBatch]:
    """Files under their canonical names, without those outside the root."""
    for b in batches:
        rows = [(os.path.realpath(p), p[len(top) :].lstrip("/"), m) for p, m in zip(b.column("path").to_pylist(), b.column("mtime").to_pylist(), strict=True)]
        rows = [r for r in rows if r[0].startswith(top.rstrip("/") + "/")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["path", "relative", "mtime"])


def read_contents(listed: DataFrame) -> DataFrame:
    """A listing with the files' contents; those that are gone since then are left out."""
    if "content" in listed.columns:
        return listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, contents, size = [], [], 0
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        contents.append(f.read())
                except FileNotFoundError:
                    continue
                kept.append(i)
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield b.take(pa.array(kept)).append_column("content", pa.array(contents, pa.binary()))
                    kept, contents, size = [], [], 0
            if kept:
                yield b.take(pa.array(kept)).append_column("content", pa.array(contents, pa.binary()))

    return listed.mapInArrow(run, "path string, relative string, mtime double, content binary")


def decoded(content):
    """The text of a file with line ends as \\n; null if it isn't UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\r\n?", "\n")


def read(files: DataFrame) -> DataFrame:
    """The files' documents in one pass: path, title, tags, body and reason, which is null unless the file can't be read."""
    rows = files.withColumn("raw", decoded(F.col("content")))
    rows = rows.select("path", F.col("raw").isNull().alias("bad"), parsed(F.coalesce("raw", F.lit(""))).alias("d"))
    title = F.when(F.col("d.title") != "", F.col("d.title")).otherwise(title_case(stem(F.col("path"))))
    return rows.select("path", title.alias("title"), "d.tags", "d.body", F.when(F.col("bad"), "not UTF-8").alias("reason"))


def documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files' documents (path, title, tags, body), and (path, reason) of those that can't be read."""
    rows = read(files)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "reason")
