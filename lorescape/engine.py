"""The library's front: a warehouse folder with the index, and the operations on it.

The index is kept in segments (segments.py): a change of some documents writes their rows and stones for what they replace, and one
manifest names all of it, so that a change of several tables is seen whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.errors import DocumentNotFoundError
from lorescape.functions.text import distinct_tokens, normalized_target
from lorescape.operators import blocks, lexical, links, postings, semantic, store, usage
from lorescape.operators.durable import written
from lorescape.plans.search import search as search_plan
from lorescape.schemas import schema
from lorescape.segments import FEW, Change, State, Store, packed
from lorescape.sources import markdown
from lorescape.sources.embedding import Provider

#: Texts that are embedded, and committed, at once.
ROUND = 50_000


def digest() -> Column:
    """What tells one version of a document from another."""
    return F.md5(F.to_json(F.struct("title", "tags", "body")))


def among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose column is one of the values (a column): a filter that Parquet can use where they are few, else a join."""
    few = [r[0] for r in values.distinct().limit(FEW + 1).collect()]
    return rows.where(F.col(column).isin(few) if few else F.lit(False)) if len(few) <= FEW else rows.join(values.toDF(column), column, "left_semi")


class Engine:
    """The index in a warehouse folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, warehouse: str, provider: Provider | None = None, model: str = "", round_size: int = ROUND):
        self.spark, self.root, self.provider, self.model, self.round_size = spark, warehouse.rstrip("/"), provider, model, round_size
        self.store = Store(spark, warehouse)

    # tables

    def table(self, name: str) -> DataFrame:
        """A table as it is now; empty if there is none."""
        if name == "lengths":
            state = self.store.state()
            rows = [(state.documents, state.length / state.documents if state.documents else None)]
            return self.spark.createDataFrame(rows, schema("lengths"))
        return self.store.rows(name)

    def vacuum(self) -> None:
        """Deletes all segments and manifests but the current ones; no reader or writer should be at work."""
        self.store.vacuum()

    # keeping the index

    def add(self, documents: DataFrame) -> None:
        """Puts documents (path, title, tags, body) into the index by path; those that are in it as they are cost nothing."""
        self._change(documents, None)

    def delete(self, gone: DataFrame) -> None:
        """Takes documents (doc_id) out of the index."""
        self._change(None, gone)

    def _change(self, incoming: DataFrame | None, gone: DataFrame | None) -> None:
        """Writes what is new of the incoming documents and what follows from it, and stones for the rest, in one commit."""
        s = self.store
        with self._fresh(incoming) as fresh, written((gone if gone is not None else self.store.rows("paths").where("false")).select("doc_id").distinct()) as lost:

            def make(state: State) -> Change | None:
                known = s.rows("paths", state).select("path", "doc_id", F.col("digest").alias("old"))
                marked = fresh.select("path", "digest").join(known, "path", "left").where("old is null or old <> digest").select("path", "doc_id")
                with written(marked) as changed:
                    return self._written_change(state, fresh, changed, lost)

            s.retried(make)
        s.merge()

    @contextmanager
    def _fresh(self, incoming: DataFrame | None) -> Iterator[DataFrame]:
        """The incoming documents with their digests, a row a path, written; of rows that repeat a path the largest stands."""
        if incoming is None:
            incoming = self.spark.createDataFrame([], "path string, title string, tags array<string>, body string")
        one = incoming.groupBy("path").agg(F.max(F.struct("title", "tags", "body")).alias("d")).select("path", "d.*")
        with written(one.withColumn("digest", digest())) as rows:
            yield rows

    def _written_change(self, state: State, fresh: DataFrame, changed: DataFrame, lost: DataFrame) -> Change | None:
        """Segments of a change: fresh documents, of which changed (path, doc_id) are new (without an id) or differ, and lost ones (doc_id)."""
        s, change = self.store, Change(state)
        count = changed.where("doc_id is null").count()
        ids = changed.where("doc_id is not null")
        if count:
            new = store.numbered(changed.where("doc_id is null").select("path"), s.lease(count) - 1, store.path_order())
            ids = ids.unionByName(new.select("path", "doc_id"))
        documents = s.add(change, "documents", fresh.join(ids, "path"))
        stones = changed.where("doc_id is not null").select("doc_id", F.lit(False).alias("final")).unionByName(lost.select("doc_id", F.lit(True).alias("final")))
        dead = s.add(change, "gone", stones.withColumn("at", F.lit(None).cast("long")))
        if dead is not None:
            before = among(s.rows("paths", state), "doc_id", dead.select("doc_id")).agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
            change.documents, change.length = -before["n"], -(before["length"] or 0)
        paths = named = None
        if documents is not None:
            name = links.file_name(normalized_target(F.col("path")))
            paths = s.add(change, "paths", documents.select(name.alias("name"), "doc_id", "path", digest().alias("digest"), lexical.length().cast("long").alias("length")))
            after = paths.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
            change.documents, change.length = change.documents + after["n"], change.length + after["length"]
            chunks, edges = store.derived(documents)
            s.add(change, "chunks", chunks)
            w = normalized_target(F.col("target"))
            named = s.add(change, "links", edges.withColumns({"w": w, "n": links.file_name(w)}))
            s.add(change, "postings", packed(postings.pairs(documents)))
        if documents is None and dead is None:
            return None
        self._aimed(change, paths, lost, named)
        return change

    def _aimed(self, change: Change, paths: DataFrame | None, lost: DataFrame, named: DataFrame | None) -> None:
        """Keeps what targets mean: only targets whose last part is the file name of a new or lost document, and targets that are new, are resolved."""
        s, state = self.store, change.base
        before = s.rows("paths", state)
        none = before.select("name").where("false")
        known = among(before, "doc_id", lost).select("name")
        if paths is not None:  # a document that only has another text keeps its names
            known = known.unionByName(paths.join(before.select("doc_id"), "doc_id", "left_anti").select("name"))
        targets = s.rows("targets", state)
        with written(known.distinct()) as names, written(among(targets, "n", names)) as touched:
            asked = none.select(F.col("name").alias("n"), F.col("name").alias("w")) if named is None else named.select("n", "w").distinct()
            fresh = asked.join(among(targets, "n", asked.select("n")).select("w"), "w", "left_anti").select("n", "w")
            with written(touched.select("n", "w").unionByName(fresh).distinct()) as asked:
                if not asked.limit(1).count():
                    return
                now = before.join(lost, "doc_id", "left_anti").select("name", "doc_id", "path")
                if paths is not None:
                    now = now.unionByName(paths.select("name", "doc_id", "path"))
                with written(links.meanings(asked, among(now, "name", asked.select("n")).select("doc_id", "path").distinct())) as found:
                    old = touched.select("w", F.col("dst_id").alias("old"), F.lit(True).alias("had"))
                    moved = found.join(old, "w", "left").where("had is null or not (dst_id <=> old)")
                    s.add(change, "targets", moved)
                    s.add(change, "moved", moved.where("had").select("w", F.lit(True).alias("final"), F.lit(None).cast("long").alias("at")))

    def reindex(self, root: str, embed: bool = True) -> DataFrame:
        """Brings the index in step with the files below a root; returns a row: indexed, deleted, failed.

        Every file is read and parsed once; what it gave is written for the time of the call, and only documents that differ go into the index.
        """
        with written(markdown.read(markdown.files(self.spark, root))) as found:
            gone = store.stale(self.table("paths"), found.select("path"), markdown.canonical(root).removeprefix("file://")).select("doc_id")
            with written(gone) as lost:
                counts = found.agg(F.count_if(F.col("reason").isNull()).alias("i"), F.count_if(F.col("reason").isNotNull()).alias("f")).first()
                row = (counts["i"], lost.count(), counts["f"])
                self._change(found.where("reason is null").drop("reason"), lost)
        if embed:
            self.refresh_embeddings()
        return self.spark.createDataFrame([row], "indexed long, deleted long, failed long")

    def follow(self, root: str, changes: DataFrame) -> None:
        """Takes over changes of files (path, change) below a root, as a watcher finds them: only files that are new or modified are read."""
        some = changes.where("change <> 'deleted'").select("path")
        listed = markdown.listing(self.spark, root).join(some, "path", "left_semi")
        with written(markdown.read(markdown.read_contents(listed))) as found:
            lost = self.table("paths").join(changes.where("change = 'deleted'").select("path"), "path", "left_semi")
            self._change(found.where("reason is null").drop("reason"), lost.select("doc_id"))

    def failures(self, root: str) -> DataFrame:
        return markdown.documents(markdown.files(self.spark, root))[1]

    def embed(self, rounds: int | None = None) -> DataFrame | None:
        """Vectors for the chunks that lack one: embedded, reused, failed, reason (of a failure); None without a provider.

        Pending texts are dealt to rounds of about round_size by their hash, and each round is committed by itself: a run that is killed
        has lost its last round at most, since what has a vector isn't pending any more. What a server gave before it failed
        is kept. rounds: to stop after so many.
        """
        if self.provider is None:
            return None
        s, reasons = self.store, []
        with written(self.table("embeddings").where(F.col("model") == self.model).select("content_hash", "model")) as before:
            with written(semantic.pending(self.table("chunks"), self.table("embeddings"), self.model)) as pending:
                parts = -(-pending.count() // self.round_size)
                for k in range(parts)[:rounds]:
                    reasons.append(self._round(pending.where(semantic.round_of(parts) == k)))
            done = semantic.accounting(self.table("chunks"), before, self.table("embeddings"), self.model).first()
        s.merge()
        reason = min((r for r in reasons if r), default=None)
        return self.spark.createDataFrame([(*done, reason)], "embedded long, reused long, failed long, reason string")

    def _round(self, texts: DataFrame) -> str | None:
        """Embeds texts and commits what came; the reason if some failed."""
        s = self.store
        with written(semantic.embedded(texts, self.provider, self.model)) as outcome:  # the provider runs once

            def make(state: State) -> Change | None:
                change = Change(state)
                had = s.rows("embeddings", state).where(F.col("model") == self.model).select("content_hash")
                fresh = semantic.succeeded(outcome).dropDuplicates(["content_hash", "model"]).join(had, "content_hash", "left_anti")
                return change if s.add(change, "embeddings", fresh) is not None else None

            s.retried(make)
            return semantic.reason(outcome).first()["reason"]

    def refresh_embeddings(self) -> DataFrame | None:
        """Embeds what is pending and prunes what no chunk has; None without a provider."""
        done = self.embed()
        if done is not None:
            s = self.store

            def make(state: State) -> Change | None:
                change = Change(state)
                lost = semantic.orphans(s.rows("embeddings", state), s.rows("chunks", state)).select("content_hash").distinct()
                stones = lost.select("content_hash", F.lit(True).alias("final"), F.lit(None).cast("long").alias("at"))
                return change if s.add(change, "pruned", stones) is not None else None

            s.retried(make)
        return done

    # asking

    def hits(self, query: str) -> DataFrame | None:
        """Vector hits of a query; None where BM25 has to do alone, whatever the reason."""
        if self.provider is None or not query.strip() or not semantic.has_vectors(self.table("embeddings"), self.model):
            return None
        try:
            found = self.provider.embed([query])
        except Exception:  # a search never fails because of its vector side
            return None
        if len(found) != 1 or not any(found[0]):
            return None
        return semantic.nearest(semantic.chunk_vectors(self.table("chunks"), self.table("embeddings"), self.model), found[0])

    def search(self, query: str, limit: int = 5, min_score: float = 0.0, usage_weight: float = 0.0, tags: Sequence[str] = (), project: str | None = None) -> DataFrame:
        if not 1 <= limit <= 20:
            raise ValueError("limit should be from 1 to 20")
        state, wanted = self.store.state(), lexical.searchable(query)
        hits = self.hits(query) if distinct_tokens(query) else None
        known, matching = blocks.matching(self.store, state, wanted) if wanted else (None, None)
        return search_plan(self.store.rows("documents", state), query, limit, min_score, usage_weight, tags, project, self.table("usage"), hits, self.table("chunks"), known, matching)

    def ask_context(self, query: str, limit: int = 3, usage_weight: float = 0.3, now: datetime | None = None, **scope) -> DataFrame:
        """A search whose results are recorded as retrieved."""
        found = self.search(query, limit, usage_weight=usage_weight, **scope).collect()  # limit rows
        self.record([r["doc_id"] for r in found], now)
        return self.spark.createDataFrame(found, "rank int, doc_id long, path string, title string, tags string, bm25 double, snippet string")

    def record(self, doc_ids: Sequence[int], now: datetime | None = None) -> None:
        """Counts a retrieval for each id; one that comes twice counts twice."""
        if doc_ids:
            log = self.spark.createDataFrame([(i, now or datetime.now(UTC)) for i in doc_ids], schema("retrievals"))
            s = self.store

            def make(state: State) -> Change:
                change = Change(state)
                s.add(change, "usage", usage.counted(log))
                return change

            s.retried(make)
            s.merge()

    def document(self, doc_id: int) -> DataFrame:
        found = self.store.at(self.spark.createDataFrame([(doc_id,)], "doc_id long"), self.store.state())
        if found.isEmpty():
            raise DocumentNotFoundError(f"no document {doc_id}")
        return found

    def document_chunks(self, doc_id: int) -> DataFrame:
        return self.table("chunks").where(F.col("doc_id") == doc_id).orderBy("ordinal")

    def edges(self) -> DataFrame:
        """All links with dst_id, null where no document is meant."""
        return self._edges(lambda rows: rows)

    def _edges(self, some: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The same of some links, by the kept meanings of their targets."""
        state = self.store.state()
        rows = self.store.raw("links", state)
        if rows is None:
            return self.spark.createDataFrame([], schema("links")).withColumn("dst_id", F.lit(None).cast("long"))
        own = some(self.store.live(rows, "links", state))
        meant = self.store.rows("targets", state).select("w", "dst_id")
        return own.join(meant, "w", "left").select("source_id", "ordinal", "target", "dst_id")

    def outgoing(self, doc_id: int) -> DataFrame:
        self.document(doc_id)
        return links.outgoing(self._edges(lambda rows: rows.where(F.col("source_id") == doc_id)), doc_id).orderBy("ordinal")

    def backlinks(self, doc_id: int) -> DataFrame:
        self.document(doc_id)
        meant = self.store.rows("targets").where(F.col("dst_id") == doc_id).select("w")
        return links.backlinks(self._edges(lambda rows: among(rows, "w", meant)), doc_id).orderBy("source_id")

    def usage_report(self) -> DataFrame:
        return usage.in_order(usage.report(self.table("documents"), self.table("usage")))

    def doctor(self) -> DataFrame:
        """The index's size and the state of its vectors, a line each."""
        rows = [("documents", str(self.table("documents").count())), ("full text", "built in"), ("vectors", "none")]
        states = semantic.coverage(self.table("chunks"), self.table("embeddings")).collect()  # a row a model
        rows[2:] = [(f"vectors of {r['model']}", f"{r['vectors']} of {r['chunks']}, {r['state']}") for r in states] or rows[2:]
        return self.spark.createDataFrame(rows, "what string, state string")


__all__ = ["Engine", "lexical"]
