import hashlib
import random

import pytest

from lorescape.llm import substring_dedup
from tests.llm.conftest import prose


def brute(texts, n):
    """(doc_id, n_words, n_removed, kept_sha256) by a dictionary of all windows."""
    words = [(t or "").encode().split() for t in texts]
    seen, out = {}, set()
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone |= set(range(k, k + n))
            else:
                seen[key] = (i, k)
        out.add((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def result(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [prose(900 + i, r.randint(15, 60)) for i in range(6)] + ["la la la " * 20, "one two " * 15]
    texts = [" ".join(r.choice([*passages, prose(r.random(), 10), prose(r.random(), 3)]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert result(substring_dedup.remove_repeats(df)) == brute(texts, 20)


def test_another_length(spark):
    texts = [prose(1, 30), "x " + prose(1, 30), "a b " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(substring_dedup.remove_repeats(df, start=3)) == brute(texts, 6)


def test_odd_documents(odd_docs, odd_texts, no_docs):
    rows = substring_dedup.remove_repeats(odd_docs)
    assert rows.count() == len(odd_texts) + 1
    assert result(rows) == brute(odd_texts, 20)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_longest_repeats(spark):
    passage = prose(5, 100)
    texts = [passage + " " + prose(6, 20), prose(7, 30) + " " + passage, prose(8, 50), prose(9, 25) + " " + " ".join(passage.split()[:30])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(df).collect()}
    assert got == {0: 80, 1: 80, 2: 0, 3: 20}


def test_repeated_and_missing_ids(spark):
    """An id with two texts, a row twice, and rows without an id: (1, p), (2, q), (2, p), (2, p), (null, p), (null, r r)."""
    p, q, r = prose(31, 40), prose(32, 40), prose(33, 30)
    rows = [(1, p), (2, q), (2, p), (2, p), (None, p), (None, r + " " + r)]
    got = sorted(((x["doc_id"] or 0, x["n_words"], x["n_removed"]) for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 40, 0), (0, 60, 30), (1, 40, 0), (2, 40, 0), (2, 40, 40), (2, 40, 40)]
