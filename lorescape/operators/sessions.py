"""Contexts given to sessions: which repeat the last one and can be left out, and what that has saved.

The state of a session is its last context. A context is a duplicate if it has the same hash, comes within TTL seconds of the
last one, and the index hasn't become newer meanwhile. As both outcomes refresh the time, and only an emitted context changes
the hash, that is a comparison with the event before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorescape.functions.text import estimated_tokens, sha256, strip, truncated, without_header

TTL = 1800
MOST_CONTEXT, LEAST_CONTEXT, LEAST_PROMPT = 2000, 100, 3
SHOWN = 10


def passes_gate(prompt: Column, context: Column) -> Column:
    """Prompts and contexts that are long enough to be looked at."""
    long_enough = F.char_length(without_header(context)) >= LEAST_CONTEXT
    return (F.char_length(strip(prompt)) >= LEAST_PROMPT) & long_enough & (strip(context) != "No context found")


def gated(events: DataFrame) -> DataFrame:
    """Events (session_id, ts, prompt, context, ...) that pass, with the context cut to its size and its hash."""
    rows = events.where(passes_gate(F.col("prompt"), F.col("context"))).withColumn("context", truncated(F.col("context"), MOST_CONTEXT))
    return rows.where(strip(F.col("context")) != "").withColumns({"context_hash": sha256(F.col("context")), "context_len": F.char_length("context").cast("long")})


def marked(events: DataFrame, ttl: float = TTL, tie: str = "event_id") -> DataFrame:
    """Events (session_id, ts as seconds, context_hash, context_len, index_mtime) with duplicate as a boolean.

    index_mtime must not fall within a session; 0 turns its test off.
    """
    own = Window.partitionBy("session_id").orderBy("ts", tie)
    last = F.lag(F.struct("ts", "context_hash", "index_mtime")).over(own)
    rows = events.withColumn("_last", last)
    newer = (F.col("index_mtime") > 0) & (F.col("_last.index_mtime") > 0) & (F.col("index_mtime") > F.col("_last.index_mtime"))
    same = (F.col("_last.context_hash") == F.col("context_hash")) & (F.col("ts") - F.col("_last.ts") <= ttl) & ~newer
    return rows.withColumn("duplicate", F.coalesce(same, F.lit(False))).drop("_last")


def statistics(marked: DataFrame) -> DataFrame:
    """Hits, saved characters and tokens of each session."""
    sums = marked.groupBy("session_id").agg(F.count_if("duplicate").alias("dedup_hits"), F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("context_len"))), F.lit(0)).alias("saved_chars"))
    return sums.withColumn("saved_tokens", estimated_tokens(F.col("saved_chars")))


def totals(statistics: DataFrame) -> DataFrame:
    """The same of all sessions; the tokens are rounded down from the sum, not summed."""
    sums = statistics.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("dedup_hits"), F.lit(0)).alias("dedup_hits"), F.coalesce(F.sum("saved_chars"), F.lit(0)).alias("saved_chars"))
    return sums.withColumn("saved_tokens", estimated_tokens(F.col("saved_chars")))


def shown(statistics: DataFrame) -> DataFrame:
    """The sessions of the report: those with hits, most first."""
    return statistics.where("dedup_hits > 0").orderBy(F.desc("dedup_hits"), "session_id").limit(SHOWN)
