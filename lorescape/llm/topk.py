"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Rows are dealt to shards of about SHARD_ROWS by a hash of their id, and a ball tree over each is built by one task and
written to the shared folder. Queries are packed into blocks of about BLOCK_BYTES, also in a table: none come to the driver, and the
number of jobs doesn't depend on theirs. Each block is first searched in one pilot shard; the k-th scores found there are
lower bounds that all tasks start from. Then blocks and groups of GROUP_SHARDS shards meet by a shuffle, a block and a group in
one place: the task goes through the group's shards one after another and keeps raising each query's k-th score, which they
share. In a tree, nodes are opened in the order of their upper bound <q, centre> + |q| radius, and a query leaves a node as soon as
the bound is below its k-th score; equal ones stay, since ties go to the smaller id. The partial lists, at most k a query and
group, meet in a window by query.

Scores are exact integers, and so are the k-th scores that they are compared with: products run in double precision where all
sums stay below 2^53, else as Python's integers. Components and scores beyond 64 bits raise an error.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take no part. Rows that repeat an id count
once, with the smallest vector. Rows without an id take no part. Vectors of unequal widths are compared over the components that
both have (an empty one scores 0). Fewer than k candidates are all returned; an empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorescape.llm.shared import Scratch, saved

SHARD_ROWS = 8192
LEAF_ROWS = 256
BLOCK_BYTES = 4 << 20
#: Shards that a task searches for one block, sharing its k-th scores.
GROUP_SHARDS = 16
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Doubles hold all integers up to here.
EXACT = 2**53

RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Ids and vectors with floor(scale * x) for each component; only complete and finite vectors."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # floor() would cut larger ones to 64 bits without a word
    fits = lambda v: F.when(F.abs(v * scale) < float(2**63), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component exceeds 64 bits")))
    whole = F.transform(x, fits)
    return vectors.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Rows padded with zeros; doubles if they hold the components exactly, else objects."""
    out = np.zeros((len(vectors), width), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if vectors and np.abs(out).max(initial=0) >= EXACT:
        out = np.zeros((len(vectors), width), dtype=object)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class BallTree:
    """Rows ordered so that each node is a range of them, with its centre and radius."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.width = rows.shape[1]
        order, nodes = np.arange(len(ids)), []
        real = rows.astype(np.float64)

        def node(start: int, stop: int) -> int:
            points = real[order[start:stop]]
            centre = points.mean(0)
            radius = math.sqrt(((points - centre) ** 2).sum(1).max())
            me = len(nodes)
            nodes.append([start, stop, -1, -1, centre, radius])
            if stop - start > LEAF_ROWS and radius > 0:
                far = points[((points - centre) ** 2).sum(1).argmax()]
                other = points[((points - far) ** 2).sum(1).argmax()]
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(points @ (other - far), middle)]
                nodes[me][2] = node(start, start + middle)
                nodes[me][3] = node(start + middle, stop)
            return me

        node(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.start, self.stop, self.left, self.right = (np.array([n[i] for n in nodes]) for i in range(4))
        self.centres, self.radii = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])

    def packed(self) -> bytes:
        small = self.rows.dtype != object and np.abs(self.rows).max(initial=0) < 2**15
        return pickle.dumps((self.ids, self.rows.astype(np.int16) if small else self.rows, self.start, self.stop, self.left, self.right, self.centres.astype(np.float32), self.radii))

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        self = cls.__new__(cls)
        self.ids, rows, self.start, self.stop, self.left, self.right, centres, self.radii = pickle.loads(data)
        self.rows = rows.astype(np.float64) if rows.dtype == np.int16 else rows
        self.centres, self.width = centres.astype(np.float64), self.rows.shape[1]
        return self


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None):
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        self.kth = np.full(len(ids), LOWEST, dtype=np.int64) if floor is None else floor.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted

    def search(self, tree: BallTree) -> None:
        width = min(tree.width, self.queries.shape[1])
        q, rows = self.queries[:, :width], tree.rows[:, :width]
        real = q.astype(np.float64)
        bound = real @ tree.centres[:, :width].T + self.norms[:, None] * tree.radii
        bound += 1e-4 * (1 + np.abs(bound) + self.norms[:, None] * np.sqrt((tree.centres**2).sum(1)))  # what rounding may take away
        exact = q.dtype != object and rows.dtype != object and np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * width < EXACT
        heap = [(-bound[:, 0].max(), 0, np.arange(len(self.ids)))]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bound[active, node] >= self.kth[active].astype(np.float64)]  # the bound has room for this rounding
            if not len(active):
                continue
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(heap, (-bound[active, child].max(), int(child), active))
                continue
            part = slice(tree.start[node], tree.stop[node])
            ids = tree.ids[part]
            scores = (q[active] @ rows[part].T).astype(np.int64) if exact else whole(q[active]) @ whole(rows[part]).T
            near = (scores >= (self.kth[active] if exact else self.kth[active].astype(object))[:, None]) & (self.ids[active][:, None] != ids[None, :])
            lines, columns = np.nonzero(near)
            edges = np.searchsorted(lines, np.arange(len(active) + 1))
            for i in np.unique(lines):
                mine = columns[edges[i] : edges[i + 1]]
                who = active[i]
                s = scores[i, mine]
                if len(mine) > self.k and exact:
                    keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                    mine, s = mine[keep], s[keep]
                both = self.found[who] + [(-int(x), int(c)) for x, c in zip(s, ids[mine], strict=True)]
                both.sort()
                self.found[who] = both[: self.k]
                if len(both) >= self.k:
                    self.kth[who] = max(int(self.kth[who]), min(HIGHEST, max(LOWEST, -both[self.k - 1][0])))

    def batch(self) -> pa.RecordBatch:
        rows = [(int(q), i, -s) for q, found in zip(self.ids, self.found, strict=True) for s, i in found]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])


def build(rows: DataFrame, shards: int) -> DataFrame:
    """One packed tree for each shard that has rows: (shard int, tree binary), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("shard", "ascending"), ("id", "ascending")])
        shard = whole.column("shard").to_numpy()
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            part = whole.slice(a, b - a)
            vectors = part.column("v").to_pylist()
            tree = BallTree(part.column("id").to_numpy(), matrix(vectors, max(map(len, vectors))))
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([tree.packed()], pa.binary())], names=["shard", "tree"])

    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return saved(keyed.repartition(shards, "shard").mapInArrow(run, "shard int, tree binary"), "ball-trees")


def blocked(rows: DataFrame, blocks: int) -> DataFrame:
    """The queries in blocks: (block int, queries binary), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        all_rows = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("id", "ascending")])
        block = all_rows.column("block").to_numpy()
        for s in np.unique(block):
            a, b = np.searchsorted(block, [s, s + 1])
            part = all_rows.slice(a, b - a)
            vectors = part.column("v").to_pylist()
            data = pickle.dumps((part.column("id").to_numpy(), matrix(vectors, max(1, *map(len, vectors)))))
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([data], pa.binary())], names=["block", "queries"])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    return saved(keyed.repartition(blocks, "block").mapInArrow(run, "block int, queries binary"), "query-blocks")


def piloted(blocks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """The blocks with each query's k-th score in the pilot shard (the smallest number of all where it has fewer): kth binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, queries, tree in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = Best(*pickle.loads(queries), k, None)
                best.search(BallTree.unpacked(tree))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([queries], pa.binary()), pa.array([best.kth.tobytes()], pa.binary())], names=["block", "queries", "kth"])

    first = trees.agg(F.min("shard")).first()[0]
    pilot = F.broadcast(trees.where(F.col("shard") == first).select("tree"))  # one shard's tree: about SHARD_ROWS vectors
    return saved(blocks.join(pilot).mapInArrow(run, "block int, queries binary, kth binary"), "query-floors")


def nearest(blocks: DataFrame, trees: DataFrame, k: int, shards: int, count: int) -> DataFrame:
    """The k best candidates of each query in each group of shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([Best(np.empty(0, dtype=np.int64), np.empty((0, 1)), k, None).batch()])
        ids, queries = pickle.loads(left.column("queries")[0].as_py())
        best = Best(ids, queries, k, np.frombuffer(left.column("kth")[0].as_py(), dtype=np.int64))
        for tree in right.column("tree"):
            best.search(BallTree.unpacked(tree.as_py()))
        return pa.Table.from_batches([best.batch()])

    groups = -(-shards // GROUP_SHARDS)
    asked = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = trees.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return asked.groupBy("block", "group").cogroup(held.groupBy("block", "group")).applyInArrow(run, RESULT)


def merged(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by every: the k other rows with the highest inner products.

    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    with Scratch() as temporary:
        rows = temporary.saved(quantized(vectors, scale, key, vector), "vectors")
        asked = rows.where(F.pmod("id", F.lit(every)) == 0)
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("queries")).first()
        if not size["queries"]:
            return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        shards = max(1, -(-size["n"] // SHARD_ROWS))
        count = max(1, -(-size["queries"] * (size["width"] or 1) * 8 // BLOCK_BYTES))
        trees = build(rows, shards)
        blocks = piloted(blocked(asked, count), trees, k)
    return merged(nearest(blocks, trees, k, shards, count), k)
