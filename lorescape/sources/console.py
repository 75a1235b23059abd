"""Results as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "Use this context before answering"


def search_lines(results: DataFrame) -> DataFrame:
    """(rank, line) for each result of a search."""
    return results.select("rank", F.format_string("%d. [%d] %s (%s)\n   %s", "rank", "doc_id", "title", "path", "snippet").alias("line"))


def context_block(results: DataFrame) -> DataFrame:
    """One text for a model: a header and the results in order. A search has few of them."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.format_string("[%d] %s\n%s", "doc_id", "title", "snippet").alias("t"))))
    body = F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n")
    return results.agg(F.when(F.count("*") == 0, "No context found").otherwise(F.concat(F.lit(HEADER + ":\n"), body)).alias("context"))


def usage_lines(report: DataFrame) -> DataFrame:
    last = F.coalesce(F.date_format("last_retrieved_at", "yyyy-MM-dd HH:mm"), F.lit("never"))
    return report.select("doc_id", F.format_string("%d x [%d] %s, %s", "retrieved_count", "doc_id", "title", last).alias("line"))


def usage_split_lines(lists: DataFrame) -> DataFrame:
    """(kind, place, line) of the two lists of usage.split_lists(): retrieved documents, and those never retrieved."""
    last = F.date_format("last_retrieved_at", "yyyy-MM-dd HH:mm")
    text = F.when(F.col("kind") == "retrieved", F.format_string("%d x [%d] %s, %s", "retrieved_count", "doc_id", "title", last)).otherwise(F.format_string("[%d] %s", "doc_id", "title"))
    return lists.select("kind", "place", text.alias("line"))


def link_lines(outgoing: DataFrame, backlinks: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, place, line) of a document's links: "to" those it links to, in order, and "from" those that link to it, by id."""
    ends = outgoing.select(F.lit("to").alias("kind"), F.col("ordinal").cast("long").alias("place"), F.col("dst_id").alias("doc_id"))
    ends = ends.unionByName(backlinks.select(F.lit("from").alias("kind"), F.col("source_id").alias("place"), F.col("source_id").alias("doc_id")))
    line = F.format_string("%s [%d] %s (%s)", F.when(F.col("kind") == "to", "->").otherwise("<-"), "doc_id", "title", "path")
    return ends.join(documents.select("doc_id", "path", "title"), "doc_id").select("kind", "place", line.alias("line"))


def audit_lines(audit: DataFrame) -> DataFrame:
    names = audit.columns
    return audit.select(F.explode(F.array(*[F.concat(F.lit(n.replace("_", " ") + ": "), F.col(n).cast("string")) for n in names])).alias("line"))
