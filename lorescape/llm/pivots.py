"""Near duplicates among vectors by a pivot-permutation index: ordered nearest pivots, inverted pivot lists, shared-pivot counts.

Index. Equal vectors become one node first, with a count of its rows. Pivots are nodes themselves, drawn by a hash from at most
2 * 4 sqrt(n) of n nodes (SAMPLE_BYTES bounds them) and thinned so that no two are nearer than half the angle of the wanted similarity. Each
node is described by its PREFIX nearest pivots in order, and every node is indexed. Pivots are then numbered by the length of their
inverted lists, the shortest first, and a node stands in the lists of all but its SHARED - 1 longest ones: two nodes that share at least
SHARED pivots meet in one of those lists.

Retrieval. A list's task counts, by inverted lists of its own members, how many pivots two members share. A pair belongs to
the list of the first pivot that it shares, so that each is looked at once; with SHARED or more it is a candidate, and its cosine is
computed in double precision. A list of more than CHUNK members is cut into chunks, and each pair of chunks is a task of its own. A task
returns sums and a spanning forest of its links, never the links themselves.

Hot groups. Members of a pivot's cell (its nearest nodes) that lie within half of the wanted angle of it are all similar to each other by the triangle
inequality: they are counted by the size of the cell, linked to one of them, and not compared. Where they are
more than CHUNK, they fill chunks of their own, which never meet each other. So a group of close copies costs as much as its rows.

Two 64-wide vectors with a cosine of 0.9 share 2 of 12 pivots with probability 0.998 for 4000 random pivots, more for fewer or for
higher cosines (recall() measures it against brute force); no link below the threshold is ever made.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do rows without an id, whose component is
null. Every row is a vector of its own, also where ids or vectors repeat. Unequal widths are compared as if zeros stood behind the
shorter one. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm.graph import components
from lorescape.llm.shared import Scratch, saved, small_batches

LEAST = 0.9
PREFIX, SHARED = 12, 2
#: Pivots for n nodes: PIVOT_FACTOR * sqrt(n), of which a sample twice as large comes to the driver, in at most SAMPLE_BYTES.
PIVOT_FACTOR, FEWEST, SAMPLE_BYTES = 4, 32, 64 << 20
CHUNK = 4096
#: Cells of a table of counts or products that a task holds at once.
COUNTS = 1 << 22
#: What rounding may do to an angle.
SLACK = 1e-6

NODES = "node binary, v binary"
PLACED = "node binary, copies long, v binary, prefix binary, cell int, inner boolean"
MEETING = "list int, low int, high int, chunk int, node binary, copies long, v binary, prefix binary, cell int, inner boolean"
FOUND = "node binary, other binary, links long"


def rows_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, node, v): v is the vector of unit length as doubles, node a digest of the vector; both null if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, units = [], []
            for x in b.column("x"):
                raw = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0 if x.is_valid else np.empty(0)
                most = np.abs(raw).max(initial=0)
                if not most:
                    nodes.append(None)
                    units.append(None)
                    continue
                unit = raw / most
                nodes.append(hashlib.blake2b(raw.tobytes(), digest_size=16).digest())
                units.append((unit / math.sqrt((unit**2).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "node", "v"])

    x = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(sound, x).alias("x")).mapInArrow(run, "vec_id long, node binary, v binary")


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Unit vectors as rows, with zeros behind those that are narrower than the widest or than width."""
    rows = [np.frombuffer(v, dtype=np.float64) for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def chosen(nodes: DataFrame, n: int, least: float) -> np.ndarray:
    """The pivots, as rows of a matrix of bounded size."""
    width = nodes.agg(F.max(F.length("v"))).first()[0]
    most = max(FEWEST, min(math.ceil(PIVOT_FACTOR * math.sqrt(n)), SAMPLE_BYTES // (2 * width)))
    drawn = matrix([bytes(r["v"]) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(2 * most).select("v").collect()])
    apart, kept = math.cos(math.acos(least) / 2), np.empty((most, drawn.shape[1]))
    count = 0
    for x in drawn:
        if count < most and (kept[:count] @ x < apart).all():
            kept[count] = x
            count += 1
    return kept[:count].copy()


def placed(nodes: DataFrame, pivots: np.ndarray, prefix: int, least: float) -> DataFrame:
    """Each node with its nearest pivots in order, the nearest one's number, and whether it is within half of the wanted angle of that."""
    given = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, half = given.value, math.acos(least) / 2 - SLACK
        step = max(1, COUNTS // len(p))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            near = matrix(b.column("v").to_pylist(), p.shape[1])[:, : p.shape[1]] @ p.T
            first = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
            order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
            first = np.take_along_axis(first, order, 1).astype(np.int32)
            inner = np.arccos(np.clip(near[np.arange(len(near)), first[:, 0]], -1, 1)) <= half
            columns = [b.column("node"), b.column("copies"), b.column("v"), pa.array([r.tobytes() for r in first], pa.binary()), pa.array(first[:, 0]), pa.array(inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "v", "prefix", "cell", "inner"])

    return nodes.mapInArrow(run, PLACED)


def _prefixes(b: pa.RecordBatch) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype=np.int32) for x in b.column("prefix").to_pylist()])


def lengths(index: DataFrame) -> DataFrame:
    """(list, cell, n): the members of each pivot's list that lie deep in a cell, and the others (cell -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _prefixes(b)
                cell = np.where(b.column("inner").to_numpy(zero_copy_only=False), b.column("cell").to_numpy(), -1)
                both, n = np.unique(np.stack([p.ravel(), np.repeat(cell, p.shape[1])]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int32()), pa.array(both[1], pa.int32()), pa.array(n, pa.int64())], names=["list", "cell", "n"])

    return index.select("prefix", "cell", "inner").mapInArrow(run, "list int, cell int, n long").groupBy("list", "cell").agg(F.sum("n").alias("n"))


def meeting(index: DataFrame, chunks: dict[tuple[int, int], tuple[int, int]], totals: dict[int, int], rank: np.ndarray, shared: int) -> DataFrame:
    """A row for each node, list, and pair of that list's chunks that it takes part in; pivots get their rank as number.

    chunks: for a list and a cell that is large in it, or -1, the first chunk and their number; totals: the chunks of a list.
    """
    given = index.sparkSession.sparkContext.broadcast((chunks, totals, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, whole, number = given.value
        for b in batches:
            out: list[tuple[int, int, int, int, int]] = []
            if not b.num_rows:
                continue
            ranks = np.sort(number[_prefixes(b)], axis=1)
            pivot_of = np.argsort(number)
            deep, cells = b.column("inner").to_pylist(), b.column("cell").to_pylist()
            salts = [int.from_bytes(x[:8], "little") for x in b.column("node").to_pylist()]
            for i, row in enumerate(ranks[:, : ranks.shape[1] - shared + 1].tolist()):
                for r in row:
                    p = int(pivot_of[r])
                    core = deep[i] and (p, cells[i]) in parts
                    start, count = parts[p, cells[i] if core else -1]
                    own = start + salts[i] % count
                    avoid = range(start, start + count) if core else ()
                    out += [(i, r, min(own, c), max(own, c), own) for c in range(whole[p]) if c not in avoid]
            for at in range(0, len(out), 2048):
                i, lists, low, high, own = np.array(out[at : at + 2048], dtype=np.int64).T
                kept = [b.column(c).take(pa.array(i)) for c in ("node", "copies", "v")]
                numbers = [pa.array(x, pa.int32()) for x in (lists, low, high, own)]
                rest = [pa.array([ranks[j].astype(np.int32).tobytes() for j in i], pa.binary()), *(b.column(c).take(pa.array(i)) for c in ("cell", "inner"))]
                yield pa.RecordBatch.from_arrays([*numbers, *kept, *rest], names=["list", "low", "high", "chunk", "node", "copies", "v", "prefix", "cell", "inner"])

    return index.mapInArrow(run, MEETING)


def candidates(mine: np.ndarray, theirs: np.ndarray, own: int, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two tables of pivots that share at least so many and none before own, which all have."""
    width = theirs.shape[1]
    flat = theirs.ravel()
    order = np.argsort(flat, kind="stable")
    lists, holder = flat[order], order // width
    start, stop = (np.searchsorted(lists, mine, side) for side in ("left", "right"))
    step = np.cumsum((stop - start).sum(1) + len(theirs)) // COUNTS  # rows whose counts are held at once
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(mine)]
    whole_start, whole_stop = start, stop
    for at, to in zip(edges, edges[1:], strict=False):
        asked = mine[at:to]
        start, stop = whole_start[at:to].ravel(), whole_stop[at:to].ravel()
        size = stop - start
        place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        pivot = np.repeat(asked.ravel(), size)
        cell = np.repeat(np.arange(asked.size) // width, size) * len(theirs) + holder[place]
        seen = np.bincount(cell[pivot >= own], minlength=len(asked) * len(theirs))
        seen[cell[pivot < own]] = 0  # such a pair belongs to another list
        found = np.flatnonzero(seen >= shared)
        yield found // len(theirs) + at, found % len(theirs)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that is connected with it by these links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def compared(met: DataFrame, least: float, shared: int) -> DataFrame:
    """From the rows of a pair of chunks: (node, null, links to other nodes' rows) and (node, other, 0) for a forest of links."""
    names = ["node", "other", "links"]

    def run(table: pa.Table) -> pa.Table:
        own, low, high = (table.column(c)[0].as_py() for c in ("list", "low", "high"))
        chunk = table.column("chunk").to_numpy()
        a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        prefix = np.array([np.frombuffer(x, dtype=np.int32) for x in table.column("prefix").to_pylist()])
        cell = np.where(table.column("inner").to_numpy(), table.column("cell").to_numpy(), -1)
        copies, v = table.column("copies").to_numpy(), matrix(table.column("v").to_pylist())
        links, left, right = np.zeros(len(v), dtype=np.int64), [], []
        for i, j in candidates(prefix[a], prefix[b], own, shared):
            x, y = a[i], b[j]
            open_pairs = (cell[x] < 0) | (cell[x] != cell[y])  # the others are known by their cell
            open_pairs &= (x < y) if low == high else True
            x, y = x[open_pairs], y[open_pairs]
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", v[p], v[q]) >= least
                p, q = p[near], q[near]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                label = forest(len(v), np.concatenate([*left, p]), np.concatenate([*right, q]))
                away = np.flatnonzero(label != np.arange(len(v)))
                left, right = [away], [label[away]]
        some = np.flatnonzero(links)
        left, right = (np.concatenate([np.empty(0, dtype=np.int64), *z]) for z in (left, right))
        node = table.column("node").combine_chunks()
        first = node.take(pa.array(np.concatenate([some, left])))
        second = pa.concat_arrays([pa.nulls(len(some), pa.binary()), node.take(pa.array(right)).cast(pa.binary())])
        return pa.table([first, second, pa.array(np.concatenate([links[some], np.zeros(len(left), dtype=np.int64)]))], names=names)

    return met.groupBy("list", "low", "high").applyInArrow(run, FOUND)


def duplicates(vectors: DataFrame, least: float = LEAST, prefix: int = PREFIX, shared: int = SHARED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors with a cosine of at least least), component_id (the smallest vec_id
    reachable by links), kept (whether it is that one)."""
    spark = vectors.sparkSession
    small_batches(spark)
    with Scratch() as tables:
        rows = tables.saved(rows_of(vectors, key, vector), "pivot-rows")
        sums = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value("v").alias("v"))
        nodes = tables.saved(sums, "pivot-nodes")
        n = nodes.count()
        if not n:
            return saved(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")), "pivot-links")
        pivots = chosen(nodes, n, least)
        prefix = min(prefix, len(pivots))
        shared = min(shared, prefix)
        index = tables.saved(placed(nodes, pivots, prefix, least), "pivot-index")

        sizes = {(r["list"], r["cell"]): r["n"] for r in lengths(index).collect()}  # at most a row for two pivots
        members = np.zeros(len(pivots), dtype=np.int64)
        rest: dict[int, int] = {}
        for (p, cell), size in sizes.items():
            members[p] += size
            if cell < 0 or size <= CHUNK:
                rest[p] = rest.get(p, 0) + size
        rank = np.empty(len(pivots), dtype=np.int64)
        rank[np.lexsort((np.arange(len(pivots)), members))] = np.arange(len(pivots))
        totals = {p: -(-rest.get(p, 1) // CHUNK) for p in range(len(pivots))}
        chunks = {(p, -1): (0, totals[p]) for p in range(len(pivots))}
        for (p, cell), size in sorted(sizes.items()):
            if cell >= 0 and size > CHUNK:
                chunks[p, cell] = (totals[p], -(-size // CHUNK))
                totals[p] += chunks[p, cell][1]
        found = tables.saved(compared(meeting(index, chunks, totals, rank, shared), least, shared), "pivot-found")

        deep = index.where("inner")
        cells = deep.groupBy("cell").agg(F.sum("copies").alias("all"), F.min("node").alias("head"))
        cells = tables.saved(cells, "pivot-cells")
        star = tables.saved(deep.select("node", "copies", "cell").join(cells, "cell").select("node", "head", (F.col("all") - F.col("copies")).alias("links")), "pivot-stars")
        edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(star.where("node <> head").select("node", "head"))
        parts = components(edges, keep=tables)
        links = found.where("other is null").select("node", "links").union(star.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
        named = nodes.select("node", "copies", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = tables.saved(named.join(links, "node", "left"), "pivot-named")
        least_ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
        known = tables.saved(named.join(tables.saved(least_ids, "pivot-names"), "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id"), "pivot-known")
        out = rows.select("vec_id", "node").join(known, "node", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return saved(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "pivot-links")


def recall(vectors: DataFrame, every: int = 100, least: float = LEAST, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of links of the rows whose id is divisible by every that duplicates() finds: these rows go against all, in blocks."""
    with Scratch() as tables:
        rows = tables.saved(rows_of(vectors, key, vector).where("node is not null"), "recall-rows")
        found = duplicates(vectors, least, key=key, vector=vector).where(F.pmod("vec_id", F.lit(every)) == 0).agg(F.sum("n_links")).first()[0] or 0
        asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows.count() // every // 512))))
        blocks = asked.groupBy("block").agg(F.collect_list("v").alias("q"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for q, v in zip(b.column("q").to_pylist(), b.column("vs").to_pylist(), strict=True):
                    both = matrix([*q, *v])
                    yield pa.RecordBatch.from_arrays([pa.array([int((both[: len(q)] @ both[len(q) :].T >= least).sum())], pa.int64())], names=["links"])

        stacks = rows.groupBy(F.pmod(F.xxhash64("node", "vec_id"), F.lit(max(1, rows.count() // 2048))).alias("stack")).agg(F.collect_list("v").alias("vs"))
        true = blocks.crossJoin(stacks).mapInArrow(run, "links long").agg(F.sum("links")).first()[0] or 0  # a stated query set, in blocks
        true -= asked.count()
    return min(1.0, found / true) if true else 1.0
