"""Duplicate contexts as a stream: the state of each session, kept by Spark, decides for each event as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.operators.sessions import TTL

OUT = "session_id string, event_id long, ts double, duplicate boolean, dedup_hits long, saved_chars long"
#: How many times ttl a session's state is kept after its last event has arrived.
KEEP = 2
STATE = "context_hash string, ts double, index_mtime double, context_len long, hits long, saved long"


def deduplicated(events: DataFrame, ttl: float = TTL, keep: float | None = None) -> DataFrame:
    """Each event (session_id, event_id, ts, context_hash, context_len, index_mtime) with duplicate and the session's counts.

    Events are taken in the order of ts within a micro-batch, and in the order of arrival across them: a late one is
    compared with the state as it is, and none is dropped. A session of which nothing arrives for keep seconds (KEEP * ttl unless given)
    ends: a row without an event has its counts, and its state goes. An event that comes after that begins the session anew, so that the
    counts of a session are the sums of its ended() rows and of what its last events say.
    """
    silence = int(1000 * (KEEP * ttl if keep is None else keep))
    columns = [c.split()[0] for c in OUT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, last[1], None, last[4], last[5])], columns=columns).astype({"event_id": "Int64", "duplicate": "boolean"})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            hits, saved = (last[4], last[5]) if last else (0, 0)
            newer = last is not None and r.index_mtime > 0 and last[2] > 0 and r.index_mtime > last[2]
            same = last is not None and last[0] == r.context_hash and r.ts - last[1] <= ttl and not newer
            if same:
                last = [last[0], float(r.ts), last[2], last[3], hits + 1, saved + last[3]]
            else:
                last = [r.context_hash, float(r.ts), float(r.index_mtime), int(r.context_len), hits, saved]
            out.append((key[0], int(r.event_id), float(r.ts), bool(same), last[4], last[5]))
        state.update(tuple(last))
        state.setTimeoutDuration(silence)
        yield pd.DataFrame(out, columns=columns)

    wanted = events.select("session_id", "event_id", F.col("ts").cast("double"), "context_hash", F.col("context_len").cast("long"), F.col("index_mtime").cast("double"))
    return wanted.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout")


def ended(marked: DataFrame) -> DataFrame:
    """Counts of sessions that have ended, from what deduplicated() has written: session_id, dedup_hits, saved_chars."""
    return marked.where("event_id is null").groupBy("session_id").agg(F.sum("dedup_hits").alias("dedup_hits"), F.sum("saved_chars").alias("saved_chars"))


def retrievals_by_time(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Retrievals (ts, doc_id) counted by time windows; an extension, with a watermark that closes a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "doc_id").agg(F.count("*").alias("retrievals"))
