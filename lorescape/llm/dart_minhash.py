"""Near duplicates by DartMinHash: weighted signatures from hashed darts, a banded join, and an exact check of each candidate.

Signature. A document is a set of shingles (SHINGLE words in a row) with positive weights. The axis of weights over each shingle is
cut into regions [0, 1), [1, 2), [2, 4), [4, 8) and so on; on each region fall darts at the times of a Poisson process with the
region's width as rate, which is a function of the shingle and the region alone, and each has a height in its region. Those up to a
time T = t / (total weight) are thrown, about t = k ln k + 2k for the whole document, whatever its size, and those below the
shingle's weight count. Each dart hits one of k coordinates, and the earliest on a coordinate is its signature there; should one
stay empty, T is doubled for that document. Two documents agree on a coordinate with a probability equal to their weighted Jaccard
similarity. The cost is one hash a region, of which a weight w has 1 + log2 w, and at most about 2t darts (more for weights below 1:
their region is thrown at as a whole), not k hashes a shingle. signatures() takes any positive weights. Documents are compared
by weights of 1 ("set", for the Jaccard similarity of the sets, which the queries use) or by a shingle's number of occurrences ("count").

Join. Equal sets become one node first. The sets of a pair's members are joined to it by id; an id with more than CHUNK pairs is dealt
out to parts of about that many, each with a copy of its set. BANDS bands of ROWS coordinates make keys; documents that share one are candidates. With
the defaults a pair of similarity 0.8 is missed with probability 8e-5, one of 0.9 with 1e-9. Within a key's bucket no pairs are
spelled out: all members are compared with a leader (round 1); buckets whose members are still in several
components are compared with a second leader from outside the first one's component (round 2); for what then remains
rest_pairs() finds the pairs of different components that can be similar at all by what sets them apart from the leader. So no link
between candidates is lost, and a bucket of n copies costs about n comparisons. Comparisons are exact, on sets of 64-bit
shingle hashes.

Defined cases: null and empty texts have no shingles and form classes by themselves; a text of fewer than SHINGLE words has
one shingle of all its words; rows that repeat an id and its text share a class, and those that share an id alone are linked by each of their texts and get the
smallest of its classes; rows without an id have no class (null) in the result of classes(), and keep_one() tells documents without an id or with a repeated one apart by id and text; an empty table
gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm import words
from lorescape.llm.graph import components
from lorescape.llm.shared import Scratch, saved, slices

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
#: A list of ids of up to so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Shingles whose darts are thrown at once; a larger document is alone.
STRIPS = 1 << 17
#: Pairs that meet one copy of a set.
CHUNK = 256

SIGNED = "doc_id long, digest binary, size int, bands array<long>"
PAIRS = "a long, b long, similarity double"


def shingle_sets(texts: pa.Array, weights: str = "set") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text of an Arrow column in ascending order, and their weights.

    A shingle is the hash of SHINGLE words in a row, or of all words of a text that has fewer.
    """
    for h in words.hashed_column(texts):
        elements, counts = np.unique(words.stretches(h, min(SHINGLE, len(h))) if len(h) else h, return_counts=True)
        yield elements, counts if weights == "count" else np.ones(len(elements), dtype=np.int64)


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The regions below these weights: hash, lower end, width, and the weight itself."""
    count = 1 + np.maximum(0, np.ceil(np.log2(weights))).astype(np.int64)
    if count.max(initial=1) == 1:
        return words.mixed(elements), np.zeros(len(elements)), np.ones(len(elements)), weights
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        own = words.mixed(np.repeat(elements, count) + nth.astype(np.uint64) * words.C)
    width = np.exp2(np.maximum(0, nth - 1))
    return own, np.where(nth > 0, width, 0.0), width, np.repeat(weights, count)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each set of elements and positive weights k coordinates; sets must not be empty."""
    group = np.cumsum([len(e) for e, _ in sets]) // STRIPS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sets)]
    return np.concatenate([_signatures(sets[a:b], k) for a, b in zip(edges, edges[1:], strict=False)]) if sets else np.empty((0, k), dtype=np.uint64)


def _signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    out = np.zeros((len(sets), k), dtype=np.uint64)
    darts = k * math.log(k) + 2 * k
    plain = all(w.min() == w.max() == 1 for _, w in sets)  # then every dart of a shingle's one region counts
    cut = [(words.mixed(e),) if plain else regions(e, np.asarray(w, dtype=np.float64)) for e, w in sets]
    open_sets, limit = np.arange(len(sets)), np.array([darts / np.sum(w) for _, w in sets])
    while len(open_sets):
        strip, *more = (np.concatenate([cut[s][i] for s in open_sets]) for i in range(len(cut[0])))
        own = np.repeat(np.arange(len(open_sets)), [len(cut[s][0]) for s in open_sets])
        time, until = np.zeros(len(strip)), limit[own]
        places, times, darts_hit, n = [], [], [], 0
        while len(strip):
            n += 1
            with np.errstate(over="ignore"):
                dart = words.mixed(strip + np.uint64(n) * words.A)
            step = np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time = time - (step if plain else step / more[1])
            alive = time < until
            strip, own, time, until, *more = (x[alive] for x in (strip, own, time, until, *more))
            dart = words.mixed(dart[alive])
            hit = slice(None)
            if not plain:
                low, width, weight = more
                hit = low + width * ((words.mixed(dart ^ words.C) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < weight
            places.append((own * k + (dart % np.uint64(k)).astype(np.int64))[hit])
            times.append(time[hit])
            darts_hit.append(dart[hit])
        place, found = np.concatenate(places), np.concatenate(darts_hit)
        order = np.argsort(-np.concatenate(times), kind="stable")  # the earliest is written last
        board, filled = np.zeros(len(open_sets) * k, dtype=np.uint64), np.zeros(len(open_sets) * k, dtype=bool)
        board[place[order]], filled[place] = found[order], True
        full = filled.reshape(-1, k).all(1)
        out[open_sets[full]] = board.reshape(-1, k)[full]
        open_sets, limit = open_sets[~full], limit[~full] * 2
    return out


def banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = words.mixed(key ^ parts[:, :, r])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets in ascending order."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def signed(docs: DataFrame, weights: str, bands: int, rows: int) -> DataFrame:
    """For each document with shingles: a digest of its weighted set, its size, and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, sets = [], []
            for doc, found in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), weights), strict=True):
                if len(found[0]):
                    ids.append(doc)
                    sets.append(found)
            if not ids:
                continue
            digests = [hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).digest() for e, w in sets]
            first = {d: i for i, d in reversed(list(enumerate(digests)))}  # equal sets are signed once
            places = {i: j for j, i in enumerate(sorted(first.values()))}
            keys = banded(signatures([sets[i] for i in places], bands * rows), bands, rows)
            flat = keys[[places[first[d]] for d in digests]].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([int(w.sum()) for _, w in sets], pa.int32()), lists],
                names=["doc_id", "digest", "size", "bands"],
            )

    return docs.mapInArrow(run, SIGNED)


def element_sets(docs: DataFrame, ids: DataFrame, weights: str, tables: Scratch) -> DataFrame:
    """(doc_id, elements binary) of these documents, whose ids are unique; a unit of weight is an element."""
    n = ids.count()
    some = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for elements, weight in shingle_sets(part.column("text"), weights):
                if weight.max(initial=1) > 1:
                    unit = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                    with np.errstate(over="ignore"):
                        elements = np.unique(words.mixed(np.repeat(elements, weight)) + unit.astype(np.uint64) * words.C)
                out.append(elements.tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "elements"])

    return tables.saved(some.mapInArrow(run, "doc_id long, elements binary"), "near-sets")


def with_set(rows: DataFrame, sets: DataFrame, at: str, name: str, tables: Scratch) -> DataFrame:
    """Written rows with the elements of the document whose id is in a column; an id in very many rows is dealt out."""
    own = sets.select(F.col("doc_id").alias(at), F.col("elements").alias(name))
    often = tables.saved(rows.groupBy(at).count().where(F.col("count") > CHUNK).select(at, F.ceil(F.col("count") / CHUNK).cast("int").alias("_parts")), "near-often")
    n = often.count()
    if not n:
        return rows.join(own, at)
    often = F.broadcast(often) if n <= BROADCAST_ROWS else often
    dealt = rows.join(often, at, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    copies = own.join(often, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copies, [at, "_part"]).drop("_part")


def compared(pairs: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """The exact similarity of each pair (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [similarity(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    pairs = tables.saved(pairs, "near-pairs")
    half = with_set(pairs, sets, "a", "x", tables)
    # pairs of a leader that is the larger id are as many
    often = tables.saved(pairs.groupBy("b").count().where(F.col("count") > CHUNK).select("b"), "near-often")
    whole = half.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b") if not often.limit(1).count() else with_set(tables.saved(half, "near-half"), sets, "b", "y", tables)
    return tables.saved(whole.select("a", "b", "x", "y").mapInArrow(run, PAIRS), "near-compared")


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def rest_pairs(rows: DataFrame, sets: DataFrame, least: float, tables: Scratch) -> DataFrame:
    """All pairs (a, b) of members of different components that share a leader and may be similar: (leader, doc_id, size, component).

    Written as its difference from the leader, D, a member x of size n is similar to y only if |Dx| + |Dy| - 2 |Dx & Dy| is at most
    (nx + ny)(1 - s)/(1 + s). So unless both are similar to the leader, Dx and Dy share elements, and as many that they
    share one already among the first n(1 - s)/s + 1 of the one with the larger difference and the first n(1 - s)/2s + 1 of the
    other, in any common order. The rarest come first, and a copy's own edits are rare, so few pairs meet. The leader's own component,
    by far the largest as a rule, is never joined with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.setxor1d(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pair), assume_unique=True).view(np.int64) for pair in zip(b.column("x"), b.column("y"), strict=True)]
            kept = [b.column(c) for c in member]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(parts, pa.list_(pa.int64()))], names=[*member, "difference"])

    member = ["leader", "doc_id", "size", "component", "outside"]
    rows = tables.saved(rows, "near-rest")
    home = tables.saved(rows.where("doc_id = leader").select("leader", F.col("component").alias("home")).distinct(), "near-home")
    home = F.broadcast(home) if home.count() <= BROADCAST_ROWS else home
    marked = rows.where("doc_id <> leader").join(home, "leader").select(*member[:-1], (F.col("component") != F.col("home")).alias("outside"))
    half = tables.saved(marked.join(sets.select("doc_id", F.col("elements").alias("x")), "doc_id"), "near-members")
    found = with_set(half, sets, "leader", "y", tables).select(*member, "x", "y")
    found = tables.saved(found.mapInArrow(run, "leader long, doc_id long, size int, component long, outside boolean, difference array<long>"), "near-differences")
    spread = found.select("leader", F.explode("difference").alias("e"))
    common = tables.saved(spread.groupBy("leader", "e").agg(F.count("*").alias("f")), "near-frequencies")
    each = found.select(*member, F.size("difference").alias("d"), F.explode("difference").alias("e")).join(common, ["leader", "e"])
    far = F.floor(F.col("size") * (1 - least) / least + 1e-9) + 1
    near = F.floor(F.col("size") * (1 - least) / (2 * least) + 1e-9) + 1
    first = each.groupBy(*member, "d").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("s"))  # a member's difference
    first = first.select(*member, "d", near.alias("near"), F.posexplode(F.slice("s", F.lit(1), far.cast("int"))).alias("at", "s")).where("s.f > 1")
    first = tables.saved(first.select(*member, "d", "near", "at", F.col("s.e").alias("e")), "near-prefixes")
    apart = (F.col("x.size") + F.col("y.size")) * (1 - least) / (1 + least) + 1e-6
    may = (
        (F.col("x.leader") == F.col("y.leader"))
        & (F.col("x.e") == F.col("y.e"))
        & ((F.col("x.d") < F.col("y.d")) | ((F.col("x.d") == F.col("y.d")) & (F.col("x.doc_id") < F.col("y.doc_id"))))
        & (F.col("x.component") != F.col("y.component"))
        & (2 * F.col("x.at") <= F.col("x.d") - F.col("y.d") + apart)
        & (2 * F.col("y.at") <= F.col("y.d") - F.col("x.d") + apart)
    )
    short = first.where("at < near")
    met = [x.alias("x").join(y.alias("y"), may) for x, y in ((short.where("outside"), first), (short.where("not outside"), first.where("outside")))]
    return met[0].union(met[1]).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, weights: str, least: float, tables: Scratch) -> DataFrame:
    """Compared pairs (a, b, similarity) that connect all candidates which are similar; nodes: doc_id, size, bands."""
    keyed = tables.saved(nodes.select("doc_id", "size", F.explode("bands").alias("key")), "near-keys")
    order = F.struct(F.xxhash64("doc_id", "key"), F.col("doc_id"))  # another second leader for each key
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1").select("key", "leader")
    members = tables.saved(keyed.join(tables.saved(buckets, "near-buckets"), "key"), "near-members")
    sets = element_sets(docs, members.select("doc_id").distinct(), weights, tables)

    done = compared(members.where("doc_id <> leader").select(*_pair("doc_id", "leader")).distinct(), sets, tables)
    for last in (False, True):
        parts = components(done.where(F.col("similarity") >= least), keep=tables)
        placed = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        placed = tables.saved(placed, "near-placed")
        split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        still = tables.saved(placed.join(tables.saved(split.select("key"), "near-split"), "key"), "near-still")
        if not still.limit(1).count():
            return done
        if not last:
            home = still.where("doc_id = leader").select("key", F.col("component").alias("home"))
            outside = still.join(home, "key").where("component <> home")
            second = outside.groupBy("key").agg(F.min(order).getField("doc_id").alias("second"), F.min_by("component", order).alias("apart"))
            pairs = still.join(tables.saved(second, "near-second"), "key").where("component <> apart").select(*_pair("doc_id", "second")).distinct()
        else:
            pairs = rest_pairs(still.select("leader", "doc_id", "size", "component").distinct(), sets, least, tables)
        done = done.unionByName(compared(pairs.join(done, ["a", "b"], "left_anti"), sets, tables))
    return done


def classes(docs: DataFrame, least: float = LEAST, weights: str = "set", bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (the smallest doc_id of its class), same_as (the smallest one with an equal set)."""
    every = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    read = every.where("doc_id is not null")
    if read.groupBy("doc_id").count().where("count > 1").limit(1).count():
        known = _classes_of_texts(read, least, weights, bands, rows)
    else:
        known = _classes(read, least, weights, bands, rows)
    return every.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("same_as", "doc_id").alias("same_as"))


def _classes_of_texts(read: DataFrame, least: float, weights: str, bands: int, rows: int) -> DataFrame:
    """The same where ids repeat: each text of an id is a document of its own, named by a hash of both; what comes back is by id."""
    with Scratch() as tables:
        texts = read.select(F.xxhash64("doc_id", "text").alias("own"), "doc_id", "text").dropDuplicates(["own"])
        found = tables.saved(_classes(texts.select(F.col("own").alias("doc_id"), "text"), least, weights, bands, rows).withColumnRenamed("doc_id", "own"), "near-own")
        named = tables.saved(found.join(texts.select("own", "doc_id"), "own", "right").select("doc_id", F.coalesce("class_id", "own").alias("c"), F.coalesce("same_as", "own").alias("s")), "near-named")
        for of in ("c", "s"):  # a class has the name of its smallest id
            named = named.join(tables.saved(named.groupBy(of).agg(F.min("doc_id").alias(f"{of}_id")), "near-names"), of)
        return saved(named.groupBy("doc_id").agg(F.min("c_id").alias("class_id"), F.min("s_id").alias("same_as")), "near-classes")


def _classes(read: DataFrame, least: float, weights: str, bands: int, rows: int) -> DataFrame:
    """doc_id, class_id, same_as of documents with shingles; ids are unique."""
    with Scratch() as tables:
        all_signed = tables.saved(signed(read, weights, bands, rows), "near-signed")
        firsts = tables.saved(all_signed.groupBy("digest").agg(F.min("doc_id").alias("first")), "near-firsts")
        firsts_of = all_signed.select("doc_id", "digest").join(firsts, "digest").select("doc_id", "first")
        nodes = all_signed.join(firsts, (all_signed["doc_id"] == firsts["first"]) & (all_signed["digest"] == firsts["digest"]), "left_semi").select("doc_id", "size", "bands")
        found = links(read, nodes, weights, least, tables).where(F.col("similarity") >= least)
        parts = components(found, keep=tables).select(F.col("node").alias("first"), "component")
        placed = tables.saved(firsts_of, "near-placed").join(parts, "first", "left")
        known = placed.select("doc_id", F.coalesce("component", "first").alias("class_id"), F.col("first").alias("same_as"))
        return saved(known, "near-classes")


def keep_one(docs: DataFrame, least: float = LEAST, weights: str = "set", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each class, the one with the smallest id; rows equal in id and text count once.

    Where an id is null or repeated, documents are told apart by a hash of id and text instead: rows that share an id but not a text
    are documents of their own, and so are rows without an id, which come last in their class. Those without an id and
    without words equal no other document, and all stay.
    """
    ids = docs.select(F.col(key).alias("id"))
    odd = ids.where("id is null").limit(1).count() or ids.groupBy("id").count().where("count > 1").limit(1).count()
    if not odd:
        found = classes(docs, least, weights, key=key, text=text)
        gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(key)).distinct()
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    own = F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text), F.col(text).isNull())
    known = saved(docs.select(own.alias("doc_id"), F.col(key).cast("long").alias("id")).distinct(), "near-ids")
    texts = docs.select(own.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    found = _classes(texts, least, weights, BANDS, ROWS).select("doc_id", "class_id")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id"))
    first = saved(found.join(known, "doc_id").groupBy("class_id").agg(F.min(order).getField("doc_id").alias("first")), "near-smallest")
    gone = saved(found.join(first, "class_id").where("doc_id <> first").select(F.col("doc_id").alias("__near_own")), "near-gone")
    kept = docs.withColumn("__near_own", own).join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "__near_own", "left_anti")
    wordless = F.col(key).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = kept.withColumn("__near_row", F.when(wordless, F.monotonically_increasing_id()).otherwise(-1))
    return kept.dropDuplicates(["__near_own", "__near_row"]).select(*docs.columns)
