import math

import numpy as np
import pytest

from lorescape.llm import pivots

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """Links of all pairs, and components by repeated passes."""
    sound = [i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e) for i, e in rows]
    width = max([len(e) for s, (_, e) in zip(sound, rows, strict=True) if s], default=0)
    x = np.zeros((len(rows), width))
    for k, (_, e) in enumerate(rows):
        if sound[k]:
            x[k, : len(e)] = e
            x[k] /= np.linalg.norm(x[k])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = [float("inf") if i is None else i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            if label[b] < label[a]:
                label[a], changed = label[b], True
    return sorted((-1 if i is None else i, int(near[k].sum()), -1 if i is None else label[k], i is not None and label[k] == i) for k, (i, _) in enumerate(rows))


def result(df):
    return sorted(tuple(-1 if v is None else v for v in (r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in df.collect())


def clusters(r, sizes, width=64, noise=0.04):
    out = []
    for n in sizes:
        centre = r.normal(size=width)
        out += [np.float32(centre / np.linalg.norm(centre) + noise * r.normal(size=width)).tolist() for _ in range(n)]
    return out


@pytest.mark.parametrize("chunk", [16, 4096])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    r = np.random.default_rng(5)
    vectors = clusters(r, [90, 1, 1, 25, 7, 2, 2, *[1] * 150])
    vectors += [vectors[3]] * 40  # a hot group of equal vectors
    order = r.permutation(len(vectors))
    rows = [(int(i) * 3, vectors[k]) for i, k in enumerate(order)]
    assert result(pivots.duplicates(spark.createDataFrame([(*x, 0) for x in rows], VECTORS))) == brute(rows)


def test_pairs_around_the_threshold(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = np.linspace(0.87, 0.95, 300)[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true, found = ({i: n for i, n, *_ in z} for z in (brute(rows), result(pivots.duplicates(df))))
    assert all(found[i] <= true[i] for i in true)
    assert sum(found.values()) >= 0.97 * sum(true.values()) > 300


def test_recall_is_measured(spark):
    r = np.random.default_rng(9)
    rows = [(i, v, 0) for i, v in enumerate(clusters(r, [30, 20, 10, *[1] * 200]))]
    assert pivots.recall(spark.createDataFrame(rows, VECTORS), every=5) >= 0.99


def test_tight_cells_are_counted_without_being_compared(spark, monkeypatch):
    """All pairs of a group around one pivot come from its size: no pair of chunks holds two of its members' chunks."""
    monkeypatch.setattr(pivots, "CHUNK", 8)
    r = np.random.default_rng(2)
    vectors = clusters(r, [120], noise=0.005)
    rows = [(i, v) for i, v in enumerate(vectors)]
    met = []
    plain = pivots.compared
    monkeypatch.setattr(pivots, "compared", lambda rows, *a: met.append(rows.count()) or plain(rows, *a))
    out = result(pivots.duplicates(spark.createDataFrame([(*x, 0) for x in rows], VECTORS)))
    assert out == brute(rows) and {n for _, n, *_ in out} == {119}
    assert met[0] <= 120 * 2


def test_defined_cases(spark):
    wide = [0.0] * 8
    rows = [
        (1, [1.0] * 8), (2, None), (3, []), (4, wide), (5, [1.0, None]), (6, [float("nan")] * 8), (7, [float("inf")] * 8), (8, [-1.0] * 8), (9, [2.0] * 8), (9, [2.0] * 8), (9, [1.0, *wide[1:]]),
        (10, [1.0]), (None, [1.0] * 8), (11, [1e-30] * 8), (12, [3e38] * 8), (-5, [1.0] * 7), (13, [-0.0, 1.0]), (14, [0.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*x, 0) for x in rows], VECTORS).selectExpr("*", "1 node", "2 v", "3 links", "4 list", "5 component", "6 cell")
    assert result(pivots.duplicates(df)) == brute(rows)
    assert pivots.duplicates(df).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_empty_tables(spark):
    empty = pivots.duplicates(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert result(pivots.duplicates(spark.createDataFrame([(1, None, 0), (None, None, 0)], VECTORS))) == [(-1, 0, -1, False), (1, 0, 1, True)]
