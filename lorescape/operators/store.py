"""Keeping the index in step with its documents: each function makes the next version of a table from the last one.

Spark's files don't change in place. A version is written whole beside the last one and replaces it by name (see engine.py), so
readers see either, and a failed run leaves the last one. That is stronger than a commit for each document, and later visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorescape.functions.chunking import CAP, chunk_table
from lorescape.functions.markdown import wikilinks
from lorescape.functions.text import under
from lorescape.operators.durable import durable


def numbered(rows: DataFrame, after: int, order: Column) -> DataFrame:
    """The rows with ids after + 1, after + 2, ... in order.

    A range shuffle sorts the rows; the ids are each partition's offset, of which there is one number a partition, plus the place
    in it. No task sees all rows.
    """
    spark = rows.sparkSession
    at = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    at = durable(at)  # both uses have to see the same partitions
    part = F.shiftright("_m", 33)
    sizes = sorted(at.groupBy(part.alias("p")).count().collect())  # a row a partition
    offsets, total = {}, after
    for p, n in sizes:
        offsets[p] = total
        total += n
    if not offsets:
        return at.drop("_m").withColumn("doc_id", F.lit(None).cast("long"))
    known = spark.createDataFrame(list(offsets.items()), "_p long, _o long")
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_p", part).join(F.broadcast(known), "_p").withColumn("doc_id", F.col("_o") + inside + 1).drop("_m", "_p", "_o")


def placed(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, place): the distinct items of each group numbered from 0 in order.

    A range shuffle sorts all groups; a place is the offset of a group's part, of which there is a number a partition, plus the place
    in it. No task sees a group that is larger than a partition.
    """
    at = rows.select(group, item).distinct().repartitionByRange(group, item).sortWithinPartitions(group, item)
    at = durable(at.withColumn("_m", F.monotonically_increasing_id()))  # both uses have to see the same partitions
    at = at.withColumn("_p", F.shiftright("_m", 33))
    sizes = at.groupBy(group, "_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    sizes = sizes.select(group, "_p", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return at.join(sizes, [group, "_p"]).select(group, item, (F.col("_m") - F.col("_first") + F.col("_before")).alias("place"))


def path_order(path: str = "path") -> Column:
    """Paths as a sorted walk lists them: by their parts, not by their characters."""
    return F.split(path, "/")


def upserted(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents with the incoming ones (path, title, tags, body) put in by path; known paths keep their ids.

    Of rows that repeat a path the one with the largest title, tags and body, in this order, stands.
    """
    fresh = incoming.groupBy("path").agg(F.max(F.struct("title", "tags", "body")).alias("d")).select("path", "d.*")
    fresh = fresh.join(documents.select("path", "doc_id"), "path", "left")
    most = documents.agg(F.max("doc_id")).first()[0] or 0
    known = fresh.where("doc_id is not null")
    added = numbered(fresh.where("doc_id is null").drop("doc_id"), most, path_order())
    kept = documents.join(fresh.select("path"), "path", "left_anti")
    columns = ["doc_id", "path", "title", "tags", "body"]
    return kept.select(*columns).unionByName(known.select(*columns)).unionByName(added.select(*columns))


def replaced(table: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A side table (chunks, links) with all rows of the changed documents replaced."""
    return table.join(changed.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").unionByName(fresh)


def link_table(documents: DataFrame) -> DataFrame:
    """Links of each document in order, each target once."""
    return documents.select(F.col("doc_id").alias("source_id"), F.posexplode(wikilinks(F.col("body"))).alias("ordinal", "target"))


def derived(documents: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    return chunk_table(documents, cap), link_table(documents)


def stale(documents: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Documents with an absolute path under the root whose file (listing: path) is gone."""
    return documents.where(F.startswith("path", F.lit("/")) & under(F.col("path"), root)).join(listing.select("path"), "path", "left_anti")


def without(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table without the rows of deleted documents. Vectors aren't touched: they belong to texts, not to documents."""
    return table.join(gone.select(F.col("doc_id").alias(key)), key, "left_anti")


def missing_on_disk(documents: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    return documents.where(under(F.col("path"), root)).join(listing.select("path"), "path", "left_anti").agg(F.count("*").alias("missing"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted between two listings (path, mtime)."""
    old, new = before.select("path", F.col("mtime").alias("old")), after.select("path", F.col("mtime").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    place = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(place)).where("_r = 1").drop("_r")
