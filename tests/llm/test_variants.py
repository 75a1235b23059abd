import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorescape.llm import variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    friends = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, f in friends.items():
        best = min(f, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(friends[w]), n.get(form[w])))
    return out


def result(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def corpus(seed: int, stems: int = 25) -> list[tuple[int, str]]:
    """Words and slips of them, over documents of some words each."""
    r = random.Random(seed)
    words = []
    for _ in range(stems):
        w = "".join(r.choice("abcé") for _ in range(r.randint(5, 10)))
        words += [w] * r.choice([3, 6, 40, 300])
        for _ in range(6):
            i = r.randrange(len(w) + 1)
            v = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcÉ") + w[i:], w[:i] + r.choice("abcÉ") + w[i + 1 :]])
            words += [v] * r.choice([1, 5, 7, 30])
    r.shuffle(words)
    return [(i, r.choice([" ", "-", "\n"]).join(words[i * 20 : i * 20 + 20])) for i in range(-(-len(words) // 20))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_heavy_affixes_are_dealt_out(spark, monkeypatch):
    """Words that nearly all begin, or end, alike: more than a cell should have."""
    r = random.Random(4)
    stems = ["".join(r.choice("ab") for _ in range(r.randint(4, 6))) for _ in range(400)]
    words = [w for s in stems for w in ("con" + s, s + "ion") for _ in range(r.choice([2, 5, 30]))]
    rows = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(-(-len(words) // 50))]
    dealt = []
    plain = variants.cells
    monkeypatch.setattr(variants, "cells", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    assert result(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_cells_of_heavy_affixes(spark):
    from lorescape.llm.shared import Scratch

    words = spark.createDataFrame([(f"con{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")), 5) for i in range(3000)], "word string, n long")
    with Scratch() as tables:
        cells = variants.cells(words, tables).where("deal = 1")
        sizes = [r["count"] for r in cells.groupBy("cell", "a", "b").count().collect()]
        assert len(sizes) >= 16 and max(sizes) < 3000
        pairs = cells.alias("x").join(cells.alias("y"), "a b cell".split()).where("x.indexed and y.asking").selectExpr("x.word w", "y.word v")
        assert pairs.distinct().count() == pairs.count() == 3000**2


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=4, max_size=8), min_size=1, max_size=60), st.data())
def test_near_words(words, data):
    words = sorted(words)
    indexed = np.array([i for i in range(len(words)) if data.draw(st.booleans())], dtype=np.int64)
    asking = np.arange(len(words))
    found = set()
    for first in (True, False):
        x, y = variants.near_words(words, indexed, asking, first)
        pairs = set(zip(x.tolist(), y.tolist(), strict=True))
        assert len(pairs) == len(x) and not pairs & found
        found |= pairs
    assert found == {(i, int(j)) for i in range(len(words)) for j in indexed if near(words[i], words[j])}


@given(st.permutations(range(13)), st.lists(st.tuples(*[st.integers(0, 13)] * 4), max_size=20))
def test_wavelet_reports_rectangles(values, rectangles):
    values = np.array(values)
    a, b, c, d = np.array(rectangles, dtype=np.int64).reshape(-1, 4).T
    who, value = variants.Wavelet(values).report(a, b, c, d)
    want = sorted((k, int(v)) for k, (a, b, c, d) in enumerate(rectangles) for v in values[a:b] if c <= v < d)
    assert sorted(zip(who.tolist(), value.tolist(), strict=True)) == want


def test_defined_cases(spark, odd_docs, odd_texts, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(variants.variants(odd_docs)) == brute(rows)
    empty = variants.variants(no_docs)
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    long = [(None, "x" * 3000 + " "), (None, "x" * 3001 + " Straße straße STRAßE straße straße straßen"), (3, None), (3, ""), (3, "×÷×÷×÷ ×÷×÷×÷"), (3, "ÀÉÎõü")]
    long = long * 5
    assert result(variants.variants(spark.createDataFrame(long, "doc_id long, text string"))) == brute(long)
