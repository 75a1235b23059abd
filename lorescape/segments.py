"""The engine's tables as logs of segments, so that a small change writes little.

A segment is a folder of Parquet that never changes. A manifest names all segments of all tables, each with the number of the
change that it belongs to. A row is replaced or deleted by a stone: a key, in a segment of stones, which hides all rows of older changes with that key.
Reading a table means reading its segments without the rows that stones hide. Where FAN segments of a table are of about one size they are
merged into one, without hidden rows, and stones that no segment needs any more are dropped; so a row is rewritten a number of times
that grows as the logarithm of the table.

Commits are optimistic. A change is written first, then its manifest under the next number. If another writer has taken that number, the change is
put on top of the other's, provided that both touch different documents and link targets; else Clash is raised and the change is made anew from the new
state. New ids are leased by a commit of their own, so that no two writers hand out the same. Manifests get their name by a hard link on
a local disk and by a rename elsewhere, which are atomic there and on HDFS; an object store has to refuse to overwrite.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.errors import Clash, WarehouseError
from lorescape.schemas import schema

MANIFEST = "manifests"
#: Segments of one size that are merged.
FAN = 8
#: Rows of a file of documents: what a search reads at least of a document's neighbours.
BLOCK_ROWS = 4096
#: Documents of a row of postings, as a power of 2; a file's directory is in the same unit.
SHIFT = 12
#: Stones and ids up to so many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Values up to so many become a filter that Parquet can use.
FEW = 1000
TRIES = 10


@dataclass(frozen=True)
class Kind:
    """How a table is kept: the order within a segment, the key that stones name, and which stones."""

    order: tuple[str, ...]
    key: str = "doc_id"
    stones: str | None = "gone"
    final: bool = False  # only stones of deleted documents count


KINDS = {
    "documents": Kind(("doc_id",)),
    "paths": Kind(("name", "doc_id")),
    "links": Kind(("source_id", "ordinal"), "source_id"),
    "targets": Kind(("n", "w"), "w", "moved"),
    "chunks": Kind(("doc_id", "ordinal")),
    "postings": Kind(("gram", "block")),
    "embeddings": Kind(("model", "content_hash"), "content_hash", "pruned"),
    "usage": Kind(("doc_id",), final=True),
    "gone": Kind(("doc_id",), stones=None),
    "moved": Kind(("w",), "w", None),
    "pruned": Kind(("content_hash",), "content_hash", None),
}
STONES = ("gone", "moved", "pruned")
#: What two changes must not have in common: columns of the one's segments and of the other's. A new or lost name can change what a target means.
OVERLAPS = (
    ("gone", "doc_id", "gone", "doc_id"),
    ("paths", "name", "paths", "name"),
    ("paths", "name", "targets", "n"),
    ("targets", "n", "paths", "name"),
    ("targets", "n", "targets", "n"),
    ("targets", "dst_id", "gone", "doc_id"),
    ("gone", "doc_id", "targets", "dst_id"),
)


@dataclass
class State:
    """What a manifest says: segments (table, id, at, rows), the next free id, documents and their length in trigrams."""

    number: int = 0
    segments: list[dict] = field(default_factory=list)
    next_id: int = 1
    documents: int = 0
    length: int = 0

    def of(self, table: str) -> list[dict]:
        return [s for s in self.segments if s["table"] == table]


@dataclass
class Change:
    """Written segments on top of a state, not yet named; at is null for those that get the commit's number."""

    base: State
    adds: list[dict] = field(default_factory=list)
    removed: set[str] = field(default_factory=set)
    documents: int = 0
    length: int = 0
    lease: int = 0

    def on(self, state: State) -> State:
        number = state.number + 1
        kept = [s for s in state.segments if s["id"] not in self.removed]
        added = [s | {"at": number if s["at"] is None else s["at"]} for s in self.adds]
        segments = kept + added
        oldest = min((s["at"] for s in segments if s["table"] not in STONES), default=number)
        segments = [s for s in segments if s["table"] not in STONES or s["at"] > oldest]
        return State(number, segments, state.next_id + self.lease, state.documents + self.documents, state.length + self.length)


def opened(rows: DataFrame) -> DataFrame:
    """Postings as (gram, doc_id)."""
    ids = F.explode(F.transform("ids", lambda i: F.shiftleft("block", SHIFT) + i.cast("long")))
    return rows.select("gram", ids.alias("doc_id"), *[c for c in rows.columns if c.startswith("_")])


def packed(pairs: DataFrame) -> DataFrame:
    """(gram, doc_id) as rows of one gram and 2 ** SHIFT ids at most: their places in the block in order."""
    place = F.col("doc_id").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("short")
    grouped = pairs.groupBy("gram", F.shiftright("doc_id", SHIFT).alias("block")).agg(F.sort_array(F.collect_list(place)).alias("ids"))
    return grouped.select("gram", "block", F.size("ids").alias("n"), "ids")


class Store:
    """Segments in a warehouse folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    # manifests

    def state(self) -> State:
        files, folder = self._files(f"{self.root}/{MANIFEST}")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            _, root = self._files(self.root)
            if files.exists(root) and any(s.getPath().getName() in KINDS for s in files.listStatus(root)):
                raise WarehouseError(f"{self.root} has tables but no manifest")
            return State()
        stream = files.open(self._files(f"{self.root}/{MANIFEST}/{max(numbers):012d}.json")[1])
        try:
            return State(max(numbers), **json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def name(self, state: State) -> None:
        """Puts a state's manifest under its number; an error if there is one already."""
        files, _ = self._files(f"{self.root}/{MANIFEST}")
        aside, final = (self._files(f"{self.root}/{MANIFEST}/{n}")[1] for n in (f".{uuid.uuid4().hex}", f"{state.number:012d}.json"))
        content = {k: v for k, v in vars(state).items() if k != "number"}
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        if files.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), final.toUri().getPath())  # unlike a rename this never replaces a file
                taken = False
            except FileExistsError:
                taken = True
            files.delete(aside, False)
        else:
            taken = files.exists(final) or not files.rename(aside, final)
            if taken:
                files.delete(aside, False)
        if taken:
            raise WarehouseError(f"{self.root} was changed by another writer")

    def _begin(self) -> None:
        """The first manifest, before any segment, so that tables without a manifest are never a fresh start."""
        try:
            self.name(State(1))
        except WarehouseError:
            pass  # there is one

    def commit(self, change: Change) -> State:
        """Names a change, if need be on top of what others have named since its base."""
        for _ in range(TRIES):
            state = self.state()
            if state.number > max(change.base.number, 1):
                self._compatible(change, state)
            new = change.on(state)
            try:
                self.name(new)
                return new
            except WarehouseError:
                continue
        raise WarehouseError(f"{self.root} is changed by too many writers")

    def _compatible(self, change: Change, state: State) -> None:
        """An error unless the change can stand on this state, which is later than its base."""
        before, now = ({s["id"] for s in x.segments} for x in (change.base, state))
        if not change.removed <= now:
            raise Clash("segments were merged by another writer")
        mine = {s["table"] for s in change.adds if s["at"] is None}
        if not mine or mine == {"usage"}:
            return
        if before - now - change.removed:
            raise Clash("segments were merged by another writer")
        theirs = [s for s in state.segments if s["id"] not in before]
        if mine & {"embeddings", "pruned"} and {s["table"] for s in theirs} & {"embeddings", "pruned", "chunks"}:
            raise Clash("vectors were changed by another writer")
        for own, column, other, of in OVERLAPS:
            left = [self._read(x).select(F.col(column).alias("x")) for x in change.adds if x["table"] == own]
            right = [self._read(x).select(F.col(of).alias("x")) for x in theirs if x["table"] == other]
            if left and right and reduce(DataFrame.union, left).join(reduce(DataFrame.union, right), "x", "left_semi").limit(1).count():
                raise Clash("another writer changed the same documents")

    def retried(self, make: Callable[[State], Change | None]) -> State:
        """Makes and commits a change, anew from the latest state if another writer's work makes that necessary."""
        for _ in range(TRIES):
            state = self.state()
            change = make(state)
            if change is None:
                return state
            try:
                return self.commit(change)
            except Clash:
                continue
        raise WarehouseError(f"{self.root} is changed by too many writers")

    def lease(self, count: int) -> int:
        """The first of so many ids that nobody else will use."""
        change = Change(self.state(), lease=count)
        return self.commit(change).next_id - count

    # segments

    def _path(self, segment: dict) -> str:
        return f"{self.root}/{segment['table']}/{segment['id']}"

    def _read(self, segment: dict, files: list[str] | None = None) -> DataFrame:
        path = self._path(segment)
        return self.spark.read.schema(schema(f"{segment['table']}_segment")).parquet(*([f"{path}/{f}" for f in files] if files else [path]))

    def add(self, change: Change, table: str, rows: DataFrame, at: int | None = None) -> DataFrame | None:
        """Writes rows as a segment of a change, in the table's order; the written rows, or None if there are none."""
        if change.base.number == 0:
            self._begin()
        kind, columns = KINDS[table], schema(f"{table}_segment").fieldNames()
        segment = {"table": table, "id": f"s-{uuid.uuid4().hex}", "at": at}
        path = self._path(segment)
        ordered = rows.select(*columns).repartitionByRange(*kind.order).sortWithinPartitions(*kind.order)
        ordered.write.option("maxRecordsPerFile", BLOCK_ROWS if table == "documents" else 0).parquet(path)
        written = self._read(segment)
        segment["rows"] = written.count()
        if not segment["rows"]:
            files, where = self._files(path)
            files.delete(where, True)
            return None
        if table == "documents":
            directory = written.select(F.col("_metadata.file_name").alias("file"), F.shiftright("doc_id", SHIFT).alias("block")).distinct()
            directory.write.parquet(f"{self.root}/blocks/{segment['id']}")
        change.adds.append(segment)
        return written

    def raw(self, table: str, state: State) -> DataFrame | None:
        """All rows of a table's segments, hidden ones included, with _at and _segment; None if there are no segments."""
        parts = [self._read(s).withColumns({"_at": F.lit(s["at"]).cast("long"), "_segment": F.lit(i)}) for i, s in enumerate(state.of(table))]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def live(self, rows: DataFrame, table: str, state: State) -> DataFrame:
        """Rows with _at, without those that stones hide."""
        kind = KINDS[table]
        oldest = min((s["at"] for s in state.of(table)), default=0)
        stones = [s for s in state.of(kind.stones) if s["at"] > oldest] if kind.stones else []
        if not stones:
            return rows
        own = KINDS[kind.stones].key
        parts = [self._read(s).where("final" if kind.final else "true").select(F.col(own).alias("_key"), F.coalesce("at", F.lit(s["at"])).alias("_until")) for s in stones]
        dead = reduce(DataFrame.union, parts).groupBy("_key").agg(F.max("_until").alias("_until"))
        dead = F.broadcast(dead) if sum(s["rows"] for s in stones) <= BROADCAST_ROWS else dead
        return rows.join(dead, (F.col(kind.key) == F.col("_key")) & (F.col("_until") > F.col("_at")), "left_anti")

    def rows(self, table: str, state: State | None = None) -> DataFrame:
        """A table as it is."""
        state = state or self.state()
        rows = self.raw(table, state)
        if rows is None:
            return self.spark.createDataFrame([], schema(table))
        if table == "postings":
            rows = opened(rows)
        rows = self.live(rows, table, state)
        if table == "usage":  # segments hold what came to each count
            rows = rows.groupBy("doc_id").agg(F.sum("retrieved_count").alias("retrieved_count"), F.max("last_retrieved_at").alias("last_retrieved_at"))
        return rows.select(*schema(table).fieldNames())

    def at(self, ids: DataFrame, state: State) -> DataFrame:
        """The documents with these ids (doc_id): only the files that hold some of them are read."""
        segments = state.of("documents")
        if not segments:
            return self.spark.createDataFrame([], schema("documents"))
        few = [r[0] for r in ids.limit(FEW + 1).collect()]
        blocks = ids.select(F.shiftright("doc_id", SHIFT).alias("block")).distinct()
        directory = reduce(DataFrame.union, [self.spark.read.parquet(f"{self.root}/blocks/{s['id']}").select(F.lit(i).alias("segment"), "file", "block") for i, s in enumerate(segments)])
        directory = directory.where(F.col("block").isin({i >> SHIFT for i in few})) if len(few) <= FEW else directory.join(blocks, "block", "left_semi")
        hit: dict[int, list[str]] = {}
        for r in directory.select("segment", "file").distinct().collect():  # at most the names of the table's files
            hit.setdefault(r["segment"], []).append(r["file"])
        parts = [self._read(segments[i], sorted(names)).withColumn("_at", F.lit(segments[i]["at"]).cast("long")) for i, names in sorted(hit.items())]
        if not parts:
            return self.spark.createDataFrame([], schema("documents"))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.where(F.col("doc_id").isin(few)) if len(few) <= FEW else rows.join(ids, "doc_id", "left_semi")
        return self.live(rows, "documents", state).drop("_at")

    # merging

    def merge(self) -> None:
        """Merges segments of about one size, FAN at a time, until no table has as many."""
        while (change := self._merged(self.state())) is not None:
            try:
                self.commit(change)
            except Clash:
                return  # another writer merges

    def _merged(self, state: State) -> Change | None:
        change = Change(state)
        for table in KINDS:
            tiers: dict[int, list[dict]] = {}
            for s in state.of(table):
                tiers.setdefault(int(math.log(s["rows"], self.fan)), []).append(s)
            for tier in tiers.values():
                if len(tier) >= self.fan:
                    self._join_segments(change, table, tier, state)
        return change if change.removed else None

    def _join_segments(self, change: Change, table: str, segments: list[dict], state: State) -> None:
        change.removed |= {s["id"] for s in segments}
        if table in STONES:
            parts = [self._read(s).withColumn("at", F.coalesce("at", F.lit(s["at"]))) for s in segments]
            key = KINDS[table].key
            rows = reduce(DataFrame.unionByName, parts).groupBy(key, "final").agg(F.max("at").alias("at"))
            self.add(change, table, rows, max(s["at"] for s in segments))
            return
        rows = reduce(DataFrame.unionByName, [self._read(s).withColumn("_at", F.lit(s["at"]).cast("long")) for s in segments])
        rows = self.live(opened(rows) if table == "postings" else rows, table, state)
        if table == "postings":
            rows = packed(rows)
        elif table == "usage":
            rows = rows.groupBy("doc_id").agg(F.sum("retrieved_count").alias("retrieved_count"), F.max("last_retrieved_at").alias("last_retrieved_at"))
        self.add(change, table, rows, state.number)

    def vacuum(self) -> None:
        """Deletes all segments and manifests but the current ones; no reader or writer should be at work."""
        state = self.state()
        named = {s["id"] for s in state.segments} | {f"{state.number:012d}.json"}
        for table in (*KINDS, "blocks", MANIFEST):
            files, folder = self._files(f"{self.root}/{table}")
            for s in files.listStatus(folder) if files.exists(folder) else ():
                if s.getPath().getName() not in named:
                    files.delete(s.getPath(), True)
