"""Search by kept postings: a query's grams are intersected block by block, from the rarest one on, and only files with candidates are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.operators import lexical
from lorescape.operators.postings import token_grams
from lorescape.segments import FEW, State, Store, opened


#: Postings of a token from which on it pays to ask for the blocks of its rarest gram first.
WORTH = 1_000_000


def holding(store: Store, state: State, lists: DataFrame, sizes: dict[str, int], token: str) -> DataFrame:
    """(doc_id) of the documents that hold all trigrams of a token: a superset of those that hold it, or equal for one trigram.

    lists: the raw postings; sizes: how long the lists of its grams are. Where they are long, the other grams' lists are read in the blocks of the rarest one
    only, as a filter that Parquet can use if these blocks are few; within a block the shortest lists are intersected first.
    """
    wanted = token_grams(token)
    if any(g not in sizes for g in wanted):
        return store.spark.createDataFrame([], "doc_id long")
    lists = lists.where(F.col("gram").isin(wanted))
    if len(wanted) > 1 and sum(sizes[g] for g in wanted) > WORTH:
        rarest = min(wanted, key=lambda g: (sizes[g], g))
        blocks = [r[0] for r in lists.where(F.col("gram") == rarest).select("block").distinct().limit(FEW + 1).collect()]
        if len(blocks) <= FEW:
            lists = lists.where(F.col("block").isin(blocks))
    grouped = lists.groupBy("_segment", "_at", "block").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("lists"))
    complete = grouped.where(F.size("lists") == len(wanted))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1)["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    found = complete.select(F.lit("").alias("gram"), "block", common.alias("ids"), "_at").where(F.size("ids") > 0)
    return store.live(opened(found), "postings", state).select("doc_id")


def matching(store: Store, state: State, wanted: list[str]) -> tuple[lexical.Statistics, DataFrame]:
    """A query's statistics, exact, and the documents that may hold all its tokens, read from the files that have such documents."""
    distinct = list(dict.fromkeys(wanted))
    mean = state.length / state.documents if state.documents else 0.0
    lists = store.raw("postings", state)
    if lists is None:
        return lexical.Statistics(state.documents, mean, dict.fromkeys(distinct, 0)), store.rows("documents", state)
    grams = sorted({g for t in distinct for g in token_grams(t)})
    sizes = {r["gram"]: r["n"] for r in lists.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram
    some = {t: holding(store, state, lists, sizes, t) for t in distinct}
    # the only gram of a token is the token; else the documents say whether its grams stand in a row
    counts = {t: ids.count() for t, ids in some.items() if len(t) == lexical.SHORTEST}
    if long := [t for t in distinct if t not in counts]:
        ids = reduce(DataFrame.union, [some[t] for t in long])
        row = store.at(ids.distinct() if len(long) > 1 else ids, state).agg(*[F.count_if(lexical.holds(t)).alias(f"n{i}") for i, t in enumerate(long)]).first()
        counts |= {t: row[f"n{i}"] for i, t in enumerate(long)}
    ids = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [some[t] for t in distinct])
    return lexical.Statistics(state.documents, mean, {t: counts[t] for t in distinct}), store.at(ids, state)
