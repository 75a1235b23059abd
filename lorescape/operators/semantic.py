"""The vector side: which chunks lack a vector, which vectors lack a chunk, and documents ranked by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorescape.errors import EmbeddingBackendError
from lorescape.schemas import DDL

CANDIDATES = 20
BATCH = 64
#: Batches in a row that may fail before a task gives up, since each may wait for the server's time limit.
GIVE_UP = 3


def cosine(query: Sequence[float], vector: Column) -> Column:
    """Cosine with a given vector in double precision; 0 for another width or a zero norm."""
    q = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in q))
    lit = F.array(*map(F.lit, q)).cast("array<double>")
    wide = vector.cast("array<double>")
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(lit, wide, lambda a, b: a * b), F.lit(0.0), add)
    own = F.sqrt(F.aggregate(F.transform(wide, lambda x: x * x), F.lit(0.0), add))
    return F.when((F.size(vector) == len(q)) & (own > 0) & (F.lit(norm) > 0), dot / (own * F.lit(norm))).otherwise(0.0)


def has_vectors(embeddings: DataFrame, model: str) -> bool:
    return not embeddings.where(F.col("model") == model).isEmpty()


def chunk_vectors(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return chunks.select("doc_id", "content_hash").join(embeddings.where(F.col("model") == model).select("content_hash", "vector"), "content_hash")


def document_scores(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """The largest cosine of each document's chunks (doc_id, vector)."""
    return vectors.groupBy("doc_id").agg(F.max(cosine(query, F.col("vector"))).alias("sim"))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = CANDIDATES) -> DataFrame:
    """The best documents whose similarity is positive, with their 0-based rank: doc_id, sim, sem_rank."""
    best = document_scores(vectors, query).where("sim > 0").orderBy(F.desc("sim"), "doc_id").limit(limit)
    return best.withColumn("sem_rank", F.row_number().over(Window.orderBy(F.desc("sim"), "doc_id")) - 1)  # over at most limit rows


def pending(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Distinct (content_hash, text) of chunks without a vector of this model."""
    known = embeddings.where(F.col("model") == model).select("content_hash")
    return chunks.select("content_hash", "text").join(known, "content_hash", "left_anti").dropDuplicates(["content_hash"])


def pruned(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors, of any model, that some chunk still has."""
    return embeddings.join(chunks.select("content_hash"), "content_hash", "left_semi")


def orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("content_hash"), "content_hash", "left_anti")


def stored(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both, the fresh vector where the two share (content_hash, model)."""
    kept = embeddings.join(fresh.select("content_hash", "model"), ["content_hash", "model"], "left_anti")
    return kept.unionByName(fresh)


def coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """For each model: vectors of current chunks, distinct chunks, and none, partial or full."""
    total = chunks.agg(F.count_distinct("content_hash").alias("chunks"))
    n = embeddings.groupBy("model").agg(F.count("*").alias("vectors"))
    state = F.when((F.col("vectors") == 0) | (F.col("chunks") == 0), "none").when(F.col("vectors") < F.col("chunks"), "partial").otherwise("full")
    return n.join(F.broadcast(total)).withColumn("state", state)  # total is one row


def embedded(rows: DataFrame, provider, model: str) -> DataFrame:
    """Vectors of (content_hash, text): the provider runs on the executors, a batch of texts at a time.

    A batch that the server refuses, or that doesn't reach it, gives one row without a vector but with the reason; the others are
    kept and the refused texts stay pending. After GIVE_UP such batches in a row a task asks no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for part in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            if failed == GIVE_UP:
                return
            vectors, why = [], ""
            try:
                vectors = provider.embed(part.column("text").to_pylist())
                if len(vectors) != part.num_rows:
                    vectors, why = [], f"{len(vectors)} vectors for {part.num_rows} texts"
            except (EmbeddingBackendError, OSError) as e:
                why = str(e) or type(e).__name__
            failed = failed + 1 if why else 0
            hashes = part.column("content_hash") if not why else pa.array([None], pa.string())
            n = len(hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    hashes,
                    pa.array([model] * n),
                    pa.array([None] if why else [len(v) for v in vectors], pa.int32()),
                    pa.array([None] if why else [list(map(float, v)) for v in vectors], pa.list_(pa.float32())),
                    pa.array([why or None] * n, pa.string()),
                ],
                names=["content_hash", "model", "dimension", "vector", "reason"],
            )

    return rows.select("content_hash", "text").mapInArrow(run, DDL["embeddings"] + ", reason string")


def round_of(rounds: int, content_hash: str = "content_hash") -> Column:
    """The round of a text, by the first digits of its hash."""
    return F.conv(F.substring(content_hash, 1, 8), 16, 10).cast("long") % rounds


def succeeded(outcome: DataFrame) -> DataFrame:
    """The vectors among what embedded() gave."""
    return outcome.where("reason is null").drop("reason")


def reason(outcome: DataFrame) -> DataFrame:
    """One row: the reason of a failed batch (the first by the alphabet), or null."""
    return outcome.agg(F.min("reason").alias("reason"))


def accounting(chunks: DataFrame, before: DataFrame, after: DataFrame, model: str) -> DataFrame:
    """What a pass has done: embedded, reused and failed chunks, by distinct hashes."""
    hashes = chunks.select("content_hash").distinct()
    had = before.where(F.col("model") == model).select("content_hash").distinct().withColumn("had", F.lit(1))
    has = after.where(F.col("model") == model).select("content_hash").distinct().withColumn("has", F.lit(1))
    rows = hashes.join(had, "content_hash", "left").join(has, "content_hash", "left")
    return rows.agg(
        F.count_if(F.col("had").isNull() & F.col("has").isNotNull()).alias("embedded"),
        F.count_if(F.col("had").isNotNull()).alias("reused"),
        F.count_if(F.col("has").isNull()).alias("failed"),
    )
