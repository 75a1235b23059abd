import math

import numpy as np
import pytest

from lorescape.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in (i for i in v if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)
        out |= {(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)}
    return out


def result(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("shard", [8, 50, 8192])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    r = np.random.default_rng(1)
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(r.normal(size=(160, 6)))]
    rows += [(i, rows[i % 7][1]) for i in range(160, 240)]  # ties
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1020, []), (1040, [1.0, 2.0]), (1060, [0.0] * 9)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows] + [(20, rows[20][1], 1)], VECTORS)
    assert result(topk.search(df, k=5)) == brute(rows, 5, 20)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 400)
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    rows = [(i, [float(i % 11), float(i % 7)]) for i in range(120)]
    assert result(topk.search(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), k=4, every=3)) == brute(rows, 4, 3)


def test_few_none_and_huge(spark):
    one = spark.createDataFrame([(0, [1.0], 0)], VECTORS)
    assert topk.search(one).count() == 0 and topk.search(one.where("false")).count() == 0
    rows = [(0, [2.0**46, 1.0]), (1, [3.0, -5.0]), (2, [3.0, -6.0])]
    assert result(topk.search(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))) == brute(rows, 20, 20)


def test_tree_bounds_prune():
    r = np.random.default_rng(2)
    rows = np.floor(64 * np.concatenate([r.normal(c, 0.01, (600, 8)) for c in (-2, 0, 2)]))
    tree = topk.BallTree.unpacked(topk.BallTree(np.arange(len(rows)), rows).packed())
    best = topk.Best(np.array([-1]), rows[-1:], 3, None)
    best.search(tree)
    scores = rows @ rows[-1]
    assert [-s for s, _ in best.found[0]] == sorted(scores, reverse=True)[:3]


def test_ties_beyond_doubles(spark):
    """Two scores of 2^53 + 3: the smaller id wins although it is found later."""
    rows = [(0, [2.0**40, 1.0]), (5, [2.0**13, 3.0]), (3, [2.0**13, 3.0]), (7, [2.0**13, 4.0])]
    rows = [(i, [a / 64, b / 64]) for i, (a, b) in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    assert result(topk.search(df, k=2)) == brute(rows, 2, 20) == {(0, 1, 7, 2**53 + 4), (0, 2, 3, 2**53 + 3)}


def test_kth_score_is_an_exact_integer():
    rows = np.array([[2**53, 3], [2**53, 2]], dtype=object)
    best = topk.Best(np.array([0]), np.array([[1, 1]], dtype=object), 1, None)
    for i, row in ((5, rows[0]), (3, rows[0]), (1, rows[1])):
        best.search(topk.BallTree(np.array([i]), row[None, :]))
    assert best.found[0] == [(-(2**53 + 3), 3)] and int(best.kth[0]) == 2**53 + 3


def test_too_large_components(spark):
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [1e30], 0), (1, [1.0], 0)], VECTORS)).collect()
