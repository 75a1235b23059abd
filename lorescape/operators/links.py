"""The link graph. A target names a document by the end of its path, or else by its file's name; the smallest id wins.

Comparing every target with every path would be a cross join. Instead each path is spelled out as all its ends (as many as it
has parts), the smallest id for each end is found by one aggregation, and targets are joined with that by equality. A name that a
third of all links share is a hot key of that join only; the names are written first, so that Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescape.functions.text import normalized_target
from lorescape.operators.durable import durable


def path_ends(path: Column) -> Column:
    """The path and all that remains behind each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def names(documents: DataFrame) -> DataFrame:
    """(name, by_path, by_name): for each path end and each file name the smallest id of a document that has it."""
    paths = documents.select("doc_id", normalized_target(F.col("path")).alias("p"))
    ends = paths.select("doc_id", F.explode(path_ends(F.col("p"))).alias("name"), F.col("p"))
    last = F.element_at(F.split("p", "/"), -1)
    return ends.groupBy("name").agg(F.min("doc_id").alias("by_path"), F.min(F.when(F.col("name") == last, F.col("doc_id"))).alias("by_name"))


def file_name(normalized: Column) -> Column:
    """The last part of a normalized target or path. What a target means depends on the documents with its last part as file name alone."""
    return F.element_at(F.split(normalized, "/"), -1)


def meanings(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """(n, w, dst_id) for normalized targets (n, w: the last part and the whole), given the documents (doc_id, path) with these names."""
    known = names(paths)
    found = targets.join(known.select(F.col("name").alias("w"), "by_path"), "w", "left")
    found = found.join(known.where("by_name is not null").select(F.col("name").alias("n"), "by_name"), "n", "left")
    return found.select("n", "w", F.when(F.col("w") != "", F.coalesce("by_path", "by_name")).alias("dst_id"))


def resolved(links: DataFrame, documents: DataFrame) -> DataFrame:
    """The links with dst_id, null where no document is meant."""
    known = durable(names(documents))  # behind an aggregation Spark couldn't split a name that very many links have
    wanted = links.withColumn("_w", normalized_target(F.col("target")))
    wanted = wanted.withColumn("_n", F.element_at(F.split("_w", "/"), -1))
    by_path = known.select(F.col("name").alias("_w"), F.col("by_path"))
    by_name = known.where("by_name is not null").select(F.col("name").alias("_n"), F.col("by_name"))
    found = wanted.join(by_path, "_w", "left").join(by_name, "_n", "left")
    return found.withColumn("dst_id", F.when(F.col("_w") != "", F.coalesce("by_path", "by_name"))).drop("_w", "_n", "by_path", "by_name")


def outgoing(edges: DataFrame, source: int | None = None) -> DataFrame:
    """Resolved links without doubles and links to oneself; ordinal is that of the first one."""
    own = edges if source is None else edges.where(F.col("source_id") == source)
    return own.where("dst_id is not null and dst_id <> source_id").groupBy("source_id", "dst_id").agg(F.min("ordinal").alias("ordinal"))


def backlinks(edges: DataFrame, target: int | None = None) -> DataFrame:
    """Distinct documents that link to each one (or to one), other than itself."""
    own = edges if target is None else edges.where(F.col("dst_id") == target)
    return own.where("dst_id is not null and dst_id <> source_id").select("dst_id", "source_id").distinct()


def graph_edges(edges: DataFrame) -> DataFrame:
    """All resolved links but those to oneself; doubles stay."""
    return edges.where("dst_id is not null and dst_id <> source_id").select("source_id", "dst_id", "ordinal")


def unresolved(edges: DataFrame) -> DataFrame:
    """Distinct targets that name no document, with the first link that has each one."""
    return edges.where("dst_id is null").groupBy("target").agg(F.min(F.struct("source_id", "ordinal")).alias("first"))


def orphans(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents at neither end of a resolved link."""
    ends = graph_edges(edges).select(F.explode(F.array("source_id", "dst_id")).alias("doc_id"))
    return documents.join(ends, "doc_id", "left_anti")
