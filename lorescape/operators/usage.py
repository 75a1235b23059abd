"""How often documents were retrieved: an append-only log, and counts made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(log: DataFrame) -> DataFrame:
    """A log (doc_id, retrieved_at), one row a retrieval, as counts."""
    return log.groupBy("doc_id").agg(F.count("*").alias("retrieved_count"), F.max("retrieved_at").alias("last_retrieved_at"))


def recorded(usage: DataFrame, log: DataFrame) -> DataFrame:
    """Counts with a batch of retrievals added; the later time stays."""
    both = usage.select("doc_id", "retrieved_count", "last_retrieved_at").unionByName(counted(log))
    return both.groupBy("doc_id").agg(F.sum("retrieved_count").alias("retrieved_count"), F.max("last_retrieved_at").alias("last_retrieved_at"))


def boosted(score: Column, count: Column, weight: float) -> Column:
    return score * (1.0 + F.lit(float(weight)) * F.log1p(F.coalesce(count, F.lit(0)).cast("double")))


def report(documents: DataFrame, usage: DataFrame) -> DataFrame:
    """All documents with their counts; sorted by count, then id, when shown."""
    rows = documents.select("doc_id", "path", "title").join(usage, "doc_id", "left")
    return rows.select("doc_id", "path", "title", F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"), "last_retrieved_at")


def in_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("retrieved_count"), "doc_id")


def split_lists(report: DataFrame, limit: int) -> DataFrame:
    """The first rows of each of two lists: retrieved documents and never retrieved ones."""
    kind = F.when(F.col("retrieved_count") > 0, "retrieved").otherwise("never")
    place = Window.partitionBy("kind").orderBy(F.desc("retrieved_count"), "doc_id")
    return report.withColumn("kind", kind).withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("documents"), F.count_if(F.col("retrieved_count") == 0).alias("never_retrieved"))


def without_orphans(usage: DataFrame, documents: DataFrame) -> DataFrame:
    return usage.join(documents.select("doc_id"), "doc_id", "left_semi")
