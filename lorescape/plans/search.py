"""Ranked search as one plan: BM25, scope, usage, fusion with vectors, drafts last, and snippets for the few rows that are left.

The order of steps is part of the result. Without a scope BM25 keeps a window of candidates before anything else looks at
them; with one it keeps all that match. The least score is asked of BM25's candidates only: a document it drops
can return through its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorescape.functions.text import distinct_tokens, tag_text
from lorescape.operators import lexical, scope, snippets
from lorescape.operators.durable import written
from lorescape.operators.usage import boosted

RRF_K = 60
WIDEN, LEAST_WINDOW = 4, 20
RESULT = "rank int, doc_id long, path string, title string, tags string, bm25 double, snippet string"


def window(limit: int, scoped: bool, widened: bool) -> int | None:
    """How many candidates BM25 keeps; None: all of them."""
    return None if scoped else max(WIDEN * limit, LEAST_WINDOW) if widened else limit


def _ahead(rows: DataFrame, of: list) -> dict[int, int]:
    """For some documents the number of rows that are ranked before each one; one pass, one row back."""
    if not of:
        return {}
    before = lambda r: (F.col("boosted") > r["boosted"]) | ((F.col("boosted") == r["boosted"]) & ((F.col("bm25") > r["bm25"]) | ((F.col("bm25") == r["bm25"]) & (F.col("doc_id") < r["doc_id"]))))
    row = rows.agg(*[F.count_if(before(r)).alias(f"n{i}") for i, r in enumerate(of)]).first()
    return {r["doc_id"]: row[f"n{i}"] for i, r in enumerate(of)}


def fused(candidates: DataFrame, hits: DataFrame, corpus: DataFrame, limit: int, allowed) -> DataFrame:
    """Reciprocal rank fusion of BM25's candidates with vector hits (doc_id, sem_rank), of which there are few.

    Of candidates without a hit only the best can get into the result, since their fused score falls with their rank; so at most
    2 * limit of them and the hits are looked at, and their exact ranks are counted in one pass. What is asked of the candidates is
    asked of a written table of their ids and scores: the corpus is scored once.
    """
    spark = corpus.sparkSession
    hit_rows = hits.select("doc_id", "sem_rank").collect()  # at most semantic.CANDIDATES
    ranks = {r["doc_id"]: r["sem_rank"] for r in hit_rows}
    ids = list(ranks)
    order = [F.desc("boosted"), F.desc("bm25"), "doc_id"]
    with written(candidates.select("doc_id", "bm25", "boosted", scope.is_draft().alias("draft"))) as scores:
        some = scores.where(F.col("doc_id").isin(ids)) if ids else scores.where("false")
        for drafts in (False, True):
            some = some.unionByName(scores.where(F.col("draft") == drafts).orderBy(*order).limit(limit))
        looked = {r["doc_id"]: r for r in some.collect()}  # the hits and 2 * limit rows
        lex = _ahead(scores, list(looked.values()))
        n_lexical = scores.count()
    missing = [i for i in ids if i not in lex]
    added = {r["doc_id"]: r["draft"] for r in corpus.where(F.col("doc_id").isin(missing) & allowed).select("doc_id", scope.is_draft().alias("draft")).collect()} if missing else {}
    pool = n_lexical + len(added)
    place = {i: n_lexical + k for k, i in enumerate(sorted(added, key=ranks.get))}
    part = lambda rank: 1 / (RRF_K + (pool if rank is None else rank))
    table = [(i, r["bm25"], r["boosted"], r["draft"], lex[i], part(lex[i]) + part(ranks.get(i))) for i, r in looked.items()]
    table += [(i, 0.0, 0.0, draft, place[i], part(None) + part(ranks[i])) for i, draft in added.items()]
    best = sorted(table, key=lambda r: (r[3], -r[5], r[4], -r[2], -r[1], r[0]))[:limit]
    known = spark.createDataFrame([(*r, k) for k, r in enumerate(best, 1)], "doc_id long, bm25 double, boosted double, draft boolean, lex_rank int, fused double, rank int")
    return corpus.where(F.col("doc_id").isin([r[0] for r in best]) if best else F.lit(False)).join(F.broadcast(known), "doc_id")  # limit rows


def ranked(
    corpus: DataFrame,
    query: str,
    limit: int = 5,
    min_score: float = 0.0,
    usage_weight: float = 0.0,
    tags: Sequence[str] = (),
    project: str | None = None,
    usage: DataFrame | None = None,
    hits: DataFrame | None = None,
    known: lexical.Statistics | None = None,
    matching: DataFrame | None = None,
) -> DataFrame | None:
    """The best documents with all their columns, rank, bm25 and boosted, and with hits also fused; None if the query asks for nothing.

    matching: all documents that may match, if they are known; then only these are read and scored.
    """
    tag = scope.project_tag(project) if project is not None else None
    wanted = lexical.searchable(query)
    if not wanted and (hits is None or not distinct_tokens(query)):
        return None
    allowed = (scope.in_project(tag) if tag else F.lit(True)) & scope.has_all(tags)
    scoped = tag is not None or bool(scope.wanted_tags(tags))
    rows = lexical.scored(corpus if matching is None else matching, wanted, known)
    most = window(limit, scoped, usage_weight > 0 or hits is not None)
    if most is not None:
        rows = rows.orderBy(F.desc("bm25"), "doc_id").limit(most)
    rows = rows.where((F.col("bm25") >= min_score) & allowed)
    if usage_weight > 0 and usage is not None:
        rows = rows.join(usage.select("doc_id", "retrieved_count"), "doc_id", "left").withColumn("boosted", boosted(F.col("bm25"), F.col("retrieved_count"), usage_weight)).drop("retrieved_count")
    else:
        rows = rows.withColumn("boosted", F.col("bm25"))
    if hits is not None:
        return fused(rows, hits, corpus, limit, allowed)
    order = [scope.is_draft(), F.desc("boosted"), F.desc("bm25"), "doc_id"]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over at most limit rows


def search(
    corpus: DataFrame,
    query: str,
    limit: int = 5,
    min_score: float = 0.0,
    usage_weight: float = 0.0,
    tags: Sequence[str] = (),
    project: str | None = None,
    usage: DataFrame | None = None,
    hits: DataFrame | None = None,
    chunks: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    known: lexical.Statistics | None = None,
    matching: DataFrame | None = None,
    quote: Callable[[Column, Sequence[str]], Column] = snippets.body_snippet,
) -> DataFrame:
    """The best documents for a query: rank from 1, doc_id, path, title, tags, bm25, snippet.

    usage: counts (doc_id, retrieved_count); hits: vector hits (doc_id, sem_rank); chunks: for snippets, a table or a
    function that makes the chunks of some documents (doc_id); known, matching: from postings, instead of a scan; quote: the window of a body without chunks.
    """
    top = ranked(corpus, query, limit, min_score, usage_weight, tags, project, usage, hits, known, matching)
    if top is None:
        return corpus.sparkSession.createDataFrame([], RESULT)
    tokens = distinct_tokens(query)
    body = F.when(F.col("bm25") > 0, quote(F.col("body"), lexical.searchable(query))).otherwise("")  # a vector hit has nothing to quote
    top = top.select("rank", "doc_id", "path", "title", tag_text(F.col("tags")).alias("tags"), "bm25", body.alias("_body"))
    if chunks is None:
        return top.withColumnRenamed("_body", "snippet").orderBy("rank")
    ids = top.select("doc_id")
    mine = chunks.join(F.broadcast(ids), "doc_id", "left_semi") if isinstance(chunks, DataFrame) else chunks(ids)  # limit rows
    found = snippets.best_chunks(mine, tokens).select("doc_id", snippets.rendered(F.col("heading"), F.col("text"), tokens).alias("_chunk"))
    top = top.join(found, "doc_id", "left").withColumn("snippet", F.coalesce(F.nullif("_chunk", F.lit("")), "_body"))
    return top.select("rank", "doc_id", "path", "title", "tags", "bm25", "snippet").orderBy("rank")
