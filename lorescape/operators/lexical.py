"""Full-text search: every token has to occur as a substring of the title, the body or the tags; ranked by BM25.

Lengths and statistics are in trigrams, as a trigram index has them, and always cover the whole corpus. Two passes read
the corpus: one sums the statistics, a row; the other scores the documents that match, and keeps the best ones while it reads.
Statistics can be kept and given to later searches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescape.functions.text import tag_text, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SHORTEST = 3


@dataclass(frozen=True)
class Statistics:
    """Documents, mean length in trigrams, and how many documents hold each token."""

    documents: int
    mean_length: float
    holding: dict[str, int]

    def idf(self, token: str) -> float:
        n = self.holding[token]
        x = math.log((self.documents - n + 0.5) / (n + 0.5))
        return x if x > 0 else LEAST_IDF


def searchable(query: str) -> list[str]:
    """The tokens that a trigram index can find; repeats count twice. None: the query matches nothing."""
    return [t for t in tokens(query) if len(t) >= SHORTEST]


def columns() -> list[Column]:
    return [F.lower("title"), F.lower("body"), F.lower(tag_text(F.col("tags")))]


def length() -> Column:
    """Trigrams of a document."""
    parts = [F.greatest(F.char_length(c) - 2, F.lit(0)) for c in (F.col("title"), F.col("body"), tag_text(F.col("tags")))]
    return parts[0] + parts[1] + parts[2]


def holds(token: str) -> Column:
    a, b, c = (F.contains(x, F.lit(token)) for x in columns())
    return a | b | c


def overlaps_itself(token: str) -> bool:
    return any(token.startswith(token[-k:]) for k in range(1, len(token)))


def frequency(token: str) -> Column:
    """Occurrences of a token in the three columns, overlapping ones included."""

    def in_one(c: Column) -> Column:
        if overlaps_itself(token):
            return F.regexp_count(c, F.lit(f"(?={token})"))  # tokens hold letters, digits and _ only
        return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(token), F.lit("")))) / len(token.encode())).cast("int")

    a, b, c = (F.when(F.contains(x, F.lit(token)), in_one(x)).otherwise(0) for x in columns())
    return a + b + c


def statistics(corpus: DataFrame, wanted: list[str]) -> Statistics:
    """One pass over the corpus that brings back a single row."""
    distinct = list(dict.fromkeys(wanted))
    row = corpus.agg(F.count("*").alias("n"), F.avg(length()).alias("mean"), *[F.count_if(holds(t)).alias(f"t{i}") for i, t in enumerate(distinct)]).first()
    return Statistics(row["n"], row["mean"] or 0.0, {t: row[f"t{i}"] for i, t in enumerate(distinct)})


def measured(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """With what a score is made of: _dl, the length, and _f0, _f1, ..., how often each distinct token occurs."""
    return rows.withColumns({"_dl": length(), **{f"_f{i}": frequency(t) for i, t in enumerate(dict.fromkeys(wanted))}})


def weighed(rows: DataFrame, wanted: list[str], known: Statistics) -> DataFrame:
    """Measured rows with their bm25 score instead."""
    distinct, score = list(dict.fromkeys(wanted)), F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("_dl") / (known.mean_length or 1.0))
    for t in wanted:
        f = F.col(f"_f{distinct.index(t)}")
        score = score + known.idf(t) * (f * (K1 + 1)) / (f + norm)
    return rows.withColumn("bm25", score).drop("_dl", *[f"_f{i}" for i in range(len(distinct))])


def scored(corpus: DataFrame, wanted: list[str], known: Statistics | None = None) -> DataFrame:
    """The matching documents with their bm25 score, higher is better."""
    if not wanted:
        return corpus.where("false").withColumn("bm25", F.lit(0.0))
    known = known or statistics(corpus, wanted)
    match = F.lit(True)
    for t in dict.fromkeys(wanted):
        match = match & holds(t)
    return weighed(measured(corpus.where(match), wanted), wanted, known)


def best(corpus: DataFrame, query: str, limit: int, known: Statistics | None = None) -> DataFrame:
    """The best documents by BM25; equal scores by smaller id."""
    return scored(corpus, searchable(query), known).orderBy(F.desc("bm25"), "doc_id").limit(limit)
