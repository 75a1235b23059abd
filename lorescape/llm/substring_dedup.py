"""Repeated passages by level-wise doubling: stretches of START words first, then those of twice as many.

A stretch can only repeat if the stretches within it do, so each level looks at what the level below has left. Level START
takes, of each window of TARGET = 2 * START words, the inner stretch of START words with the smallest hash: equal windows
choose equal ones, and few stretches are ever chosen. (Whether another stretch of the window is chosen depends on words outside of
it, so that only its own choice can speak for it.) A chosen stretch that occurs once ends the search for the windows that chose
it; only the others are extended to TARGET. There each distinct window has one first
occurrence, by document and place, and all words that a later one covers are removed. The same step goes on to 2 * TARGET
and so on in longest_repeats(), until nothing is left.

All exchanges of stretches are sums by hash (a count and the smallest place), which are formed before the shuffle: a
passage that a third of all documents share costs a row for each task. What comes back to a document is the list of
its places that occur once (level START) or first (level TARGET). The texts are joined with these lists by document, so no
task gets more than its share. Stretches are compared by 64-bit hashes at level START, where a collision only costs time, and
by 96 bits at level TARGET.

Defined cases: null and empty texts have no words; a text of fewer than TARGET words keeps them all; rows that repeat an id and
its text are judged alike (neither is earlier); rows that share an id but not a text are documents of their own, in the
order of a hash of their texts; a row without an id comes neither before nor after any other, so only what it repeats of itself is
removed; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm import words
from lorescape.llm.shared import Scratch, saved, slices

START = 10
TARGET = 2 * START
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
OTHER = np.uint64(0xD6E8FEB86659FD93)
#: What tells a row from others: its id and, where ids repeat, a hash of its text (0 elsewhere).
ROW = ["doc", "t"]
#: A list of repeated ids of up to so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
NOWHERE = np.empty(0, dtype=np.int64)


def choices(h: np.ndarray, start: int = START) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of START words, and for each window of twice as many the place of the one it chooses."""
    g = words.stretches(h, start)
    if len(h) < 2 * start:
        return g, NOWHERE
    n = len(h) - 2 * start + 1
    return g, sliding_window_view(g, start + 1).argmin(1) + np.arange(n)


def keys(h: np.ndarray, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the windows of n words at these places: 64 and 32."""
    a, b = words.stretches(h, n), words.stretches(h, n, OTHER)
    return a[at].view(np.int64), (b[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def first_of_each(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of windows with these keys at ascending places the index of the first one of each key."""
    both = np.empty(len(a), dtype=[("a", a.dtype), ("b", b.dtype)])
    both["a"], both["b"] = a, b
    return np.sort(np.unique(both, return_index=True)[1])


def kept(text: str, removed: np.ndarray) -> str:
    """SHA-256 of the words that stay, joined by a space."""
    w = words.split(text)
    return hashlib.sha256(b" ".join([x for x, gone in zip(w, removed.tolist(), strict=True) if not gone]) if removed.any() else b" ".join(w)).hexdigest()


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each of n words is in one of the windows of that length."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(batches: Iterator[pa.RecordBatch], texts: bool = False) -> Iterator[tuple]:
    """Of each row its id and hash, the hashes of its words, the text if asked for, and its lists of places (or None)."""
    for part in slices(batches, "text"):
        hashes = words.hashed_column(part.column("text"))
        plain = part.column("text").to_pylist() if texts else [None] * part.num_rows
        lists = [part.column(c) for c in part.schema.names[3:]]
        for i, (doc, t, h) in enumerate(zip(part.column("doc").to_pylist(), part.column("t").to_pylist(), hashes, strict=True)):
            yield doc, t, h, plain[i], *(c[i].values.to_numpy() if c[i].is_valid else NOWHERE for c in lists)


def _flat(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(id, hash, arrays of equal length) as batches of about 100,000 rows."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        lengths = [len(x[2]) for x in held]
        own = [pa.array(np.repeat(np.array([x[i] for x in held], dtype=np.int64), lengths)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate([x[i] for x in held])) for i in range(2, len(held[0])))], names=[*ROW, *names])

    for row in found:
        if len(row[2]):
            held.append(row)
            size += len(row[2])
        if size >= 100_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """doc, t and text (never null) of all rows, and whether any t differs from 0."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    often = saved(rows.where("doc is not null").groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("often")), "substring-ids")
    n = often.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("long").alias("t"), "text"), False
    marked = rows.join(F.broadcast(often) if n <= BROADCAST_ROWS else often, "doc", "left")
    return marked.select("doc", F.when(F.col("often"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("t"), "text"), True


def _back(rows: DataFrame, name: str) -> DataFrame:
    """Places by document: (doc, t, <name> array<int>)."""
    return rows.groupBy(*ROW).agg(F.collect_list("at").alias(name))  # as many as the document has


def lone_stretches(rows: DataFrame, start: int = START) -> DataFrame:
    """Level START: for each document the places of its chosen stretches that occur nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc, t, h, _ in _rows(batches):
                g, chosen = choices(h, start)
                at = np.unique(chosen)
                yield doc, t, g[at].view(np.int64), at.astype(np.int32)

        yield from _flat(found(), ["h", "at"])

    chosen = rows.where("doc is not null").mapInArrow(run, "doc long, t long, h long, at int")
    # of a stretch that occurs once the smallest values are its own; those of repeated rows are as many as the rows
    counted = chosen.groupBy("h").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in (*ROW, "at")))
    return saved(_back(counted.where("n = 1"), "lone"), "substring-lone")


def first_windows(rows: DataFrame, hashed: bool, lone: DataFrame, start: int = START) -> DataFrame:
    """Level TARGET: for each document the places of the windows, of those still in question, that occur there first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc, t, h, _, alone in _rows(batches):
                at = in_question(h, alone, start)
                if len(at):
                    a, b = keys(h, 2 * start, at)
                    own = first_of_each(a, b, at)
                    yield doc, t, a[own], b[own], at[own].astype(np.int32)

        yield from _flat(found(), ["a", "b", "at"])

    asked = rows.where("doc is not null").join(lone, ROW, "left").select(*ROW, "text", "lone")
    windows = asked.mapInArrow(run, "doc long, t long, a long, b int, at int")
    order = F.struct(*ROW) if hashed else F.col("doc")  # a plain number is aggregated without sorting
    firsts = windows.groupBy("a", "b").agg(F.min(order).alias("o"), F.min_by("at", order).alias("at"))
    own = [F.col("o.doc").alias("doc"), F.col("o.t").alias("t")] if hashed else [F.col("o").alias("doc"), F.lit(0).cast("long").alias("t")]
    return saved(_back(firsts.select(*own, "at"), "firsts"), "substring-firsts")


def in_question(h: np.ndarray, alone: np.ndarray, start: int = START) -> np.ndarray:
    """Places of the windows whose chosen stretch occurs more than once."""
    g, chosen = choices(h, start)
    once = np.zeros(len(g), dtype=bool)
    once[alone] = True
    return np.flatnonzero(~once[chosen])


def by_itself(h: np.ndarray, length: int) -> np.ndarray:
    """Places of windows that a text holds earlier itself."""
    at = np.arange(max(0, len(h) - length + 1))
    return np.setdiff1d(at, at[first_of_each(*keys(h, length, at), at)]) if len(at) else NOWHERE


def remove_repeats(docs: DataFrame, start: int = START, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: n_words, n_removed, and the SHA-256 of the words that stay."""
    rows, hashed = read(docs, key, text)
    lone = lone_stretches(rows, start)
    firsts = first_windows(rows, hashed, lone, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, _, h, plain, alone, first in _rows(batches, texts=True):
            again = by_itself(h, 2 * start) if doc is None else np.setdiff1d(in_question(h, alone, start), first)
            gone = covered(len(h), again, 2 * start)
            out.append((doc, len(h), int(gone.sum()), kept(plain, gone)))
            if len(out) >= 2000:
                yield _result(out)
                out = []
        if out:
            yield _result(out)

    return rows.join(lone, ROW, "left").join(firsts, ROW, "left").select(*ROW, "text", "lone", "firsts").mapInArrow(run, RESULT)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def longest_repeats(docs: DataFrame, start: int = START, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, longest): the largest of the lengths 2 * start, 4 * start, ... at which a document has a window that repeats.

    Windows of a level are looked at only where both their halves repeat; doubling ends when no candidates survive.
    """
    rows, _ = read(docs, key, text)
    lone, length, alive = lone_stretches(rows, start), 2 * start, None
    rows = rows.where("doc is not null")
    done = rows.select(*ROW).withColumn("longest", F.lit(0))
    while True:
        some = rows.join(lone, ROW, "left") if alive is None else rows.join(alive, ROW).withColumnRenamed("alive", "lone")

        def candidates(h: np.ndarray, given: np.ndarray, first: bool = alive is None, n: int = length) -> np.ndarray:
            if first:
                return in_question(h, given, start)
            at = np.sort(given)
            return at[np.isin(at + n // 2, at)]

        def run(batches: Iterator[pa.RecordBatch], candidates=candidates, n: int = length) -> Iterator[pa.RecordBatch]:
            def found():
                for doc, t, h, _, given in _rows(batches):
                    at = candidates(h, given)
                    if len(at):
                        yield doc, t, *keys(h, n, at), at.astype(np.int32)

            yield from _flat(found(), ["a", "b", "at"])

        with Scratch() as temporary:
            windows = temporary.saved(some.select(*ROW, "text", "lone").mapInArrow(run, "doc long, t long, a long, b int, at int"), "substring-level")
            counted = temporary.saved(windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "substring-repeated")
            alive = saved(_back(windows.join(counted, ["a", "b"]), "alive"), "substring-alive")
        if not alive.limit(1).count():
            return done.select(F.col("doc").alias("doc_id"), "longest")
        done = done.join(alive.select(*ROW, F.lit(length).alias("_l")), ROW, "left").select(*ROW, F.coalesce("_l", "longest").alias("longest"))
        length *= 2
