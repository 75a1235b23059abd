import random

import numpy as np
import pytest

from lorescape.llm import dart_minhash, graph
from tests.llm.conftest import prose


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Classes of all pairs whose sets of five words have a similarity of 0.8 or more."""
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in range(len(texts))}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in dart_minhash.classes(df).collect()}


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def test_agreement_is_the_weighted_similarity():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(1, 2**62, 300).astype(np.uint64))
    w = r.integers(1, 5, len(base))
    other = w.copy()
    other[:80] = r.integers(1, 5, 80)
    sets = [(base, w), (base[30:], other[30:])]
    a = {int(e): int(x) for e, x in zip(*sets[0], strict=True)}
    b = {int(e): int(x) for e, x in zip(*sets[1], strict=True)}
    true = sum(min(a[e], b.get(e, 0)) for e in a) / sum(max(a[e], b.get(e, 0)) for e in a)
    s = dart_minhash.signatures(sets, 4000)
    assert abs((s[0] == s[1]).mean() - true) < 0.04


@pytest.mark.parametrize("scale", [1.0, 7.3, 300.0])
def test_agreement_with_real_weights(scale):
    r = np.random.default_rng(1)
    base = np.unique(r.integers(1, 2**62, 200).astype(np.uint64))
    w, v = r.exponential(1, len(base)) * scale + 0.01, r.exponential(1, len(base)) * scale + 0.01
    v[:100] = w[:100]
    s = dart_minhash.signatures([(base, w), (base, v), (base, w * 2)], 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    assert abs((s[0] == s[2]).mean() - 0.5) < 0.04


def test_regions_are_few():
    own, low, width, weight = dart_minhash.regions(np.array([5, 6], dtype=np.uint64), np.array([0.5, 1000.0]))
    assert len(own) == len(set(own.tolist())) == 12 and width.sum() == 1 + 1024 and weight.tolist() == [0.5] + [1000.0] * 11


def test_ids_with_many_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "CHUNK", 4)
    r = random.Random(9)
    base = prose(110, 60)
    texts = [base] + [edited(base, r.randint(1, 9), r) for _ in range(60)] + [prose(111, 60)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["class_id"] for x in dart_minhash.classes(df, bands=60, rows=1).collect()}
    assert found == brute(texts)


def test_signatures_of_tiny_and_large_sets():
    sets = [(np.array([7], dtype=np.uint64), np.array([1])), (np.arange(1, 50_001, dtype=np.uint64), np.ones(50_000, dtype=np.int64))]
    s = dart_minhash.signatures(sets, 120)
    assert (s != 0).all()
    alone = dart_minhash.signatures(sets[:1], 120)
    assert (alone[0] == s[0]).all()  # whatever else is in the batch


def test_equals_brute_force(spark):
    r = random.Random(4)
    bases = [prose(100 + i, r.randint(30, 90)) for i in range(12)]
    texts = []
    for b in bases:
        texts += [edited(b, r.randint(0, 4), r) for _ in range(12)] + [b, b]
    texts += [prose(500 + i, 40) for i in range(20)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert classes(df) == brute(texts)


def test_chains_within_a_bucket(spark, monkeypatch):
    """With one row a band almost everything shares a bucket, so the later rounds have to find the links."""
    r = random.Random(6)
    texts = []
    for c in range(3):
        t = prose(700 + c, 80)
        for _ in range(12):  # each copy resembles the one before, not the first
            texts.append(t)
            t = edited(t, 1, r)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["class_id"] for x in dart_minhash.classes(df, bands=40, rows=1).collect()}
    assert found == brute(texts)


def test_odd_documents(odd_docs, odd_texts, no_docs):
    got = dart_minhash.classes(odd_docs)
    assert got.count() == len(odd_texts) + 1
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute(odd_texts)
    assert dart_minhash.classes(no_docs).count() == 0
    kept = dart_minhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(set(brute(odd_texts).values()))


def test_null_and_repeated_ids_lose_no_text(spark):
    a, b, c, d = (prose(800 + i, 40) for i in range(4))
    rows = [(None, a), (None, b), (None, b), (None, None), (None, None), (None, ""), (7, c), (7, d), (7, d), (8, c + " end"), (9, a)]
    left = sorted([(7, c), (7, d), (9, a), (None, b), (None, ""), (None, None), (None, None)], key=repr)
    schema = "doc_id long, text string"
    assert sorted(map(tuple, dart_minhash.keep_one(spark.createDataFrame(rows, schema)).collect()), key=repr) == left
    few = [(None, a), (None, b), (1, c)]  # without a repeated id
    assert sorted(map(tuple, dart_minhash.keep_one(spark.createDataFrame(few, schema)).collect()), key=repr) == sorted(few, key=repr)
    found = [tuple(r) for r in dart_minhash.classes(spark.createDataFrame(rows, schema)).collect()]
    assert len(found) == len(rows) and set(found) == {(7, 7, 7), (8, 7, 8), (9, 9, 9), (None, None, None)}


def test_counts_as_weights(spark):
    line = "one two three four five six "
    df = spark.createDataFrame([(0, line * 2), (1, line * 20), (2, line * 19)], "doc_id long, text string")
    assert classes(df) == {0: 0, 1: 0, 2: 0}
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.classes(df, weights="count").collect()} == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("shape", ["path", "star", "cycles"])
def test_components(spark, shape):
    n = 40
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)] + [(100, 101)], "cycles": [(i, (i + 3) % n) for i in range(n)] + [(200, 200)]}[shape]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    if shape == "path":
        assert got == dict.fromkeys(range(n + 1), 0)
    elif shape == "star":
        assert got == dict.fromkeys(range(n), 0) | {100: 100, 101: 100}
    else:
        assert got == dict.fromkeys(range(n), 0)


def test_groups_of_sets_change_nothing(monkeypatch):
    r = np.random.default_rng(5)
    sets = [(np.unique(r.integers(1, 2**62, n).astype(np.uint64)), np.ones(n, dtype=np.int64)) for n in (3, 400, 1, 90, 1000, 5)]
    whole = dart_minhash.signatures(sets, 120)
    monkeypatch.setattr(dart_minhash, "STRIPS", 100)
    assert (dart_minhash.signatures(sets, 120) == whole).all()
    other = [sets[0], (sets[1][0], sets[1][1] * 1.0)]
    mixed = dart_minhash.signatures([*other, (sets[3][0], sets[3][1] * 2.5)], 120)  # the general way gives the same for weights of 1
    assert (mixed[:2] == whole[:2]).all()
    assert dart_minhash.signatures([], 8).shape == (0, 8)
