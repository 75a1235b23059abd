import random
import re
from collections import Counter

import pytest

from lorescape.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=3, least=10, top=2000):
    """From (lang, text): counts of all phrases, cut by cut."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if len(p[1]) == 1 or c >= least}
    best = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            covered = any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * c >= 50 * a for (x, q), c in f.items() if len(q) > 1)
            if not covered:
                score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in best.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def result(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def corpus(seed: int, n: int = 160) -> list[tuple[int, str, str | None]]:
    r = random.Random(seed)
    words = ["the", "of", "new", "york", "city", "hall", "New", "ß", "Ä", "ä", "1", "x-y", "don't", "."]
    made = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " "]) for _ in range(r.randint(0, 60)))
    return [(i, made() + r.choice(["", "new york city hall new york city", "a a a a a a a"]), r.choice(["en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert result(collocations.collocations(df)) == brute([(x, t) for _, t, x in rows])


def test_longer_phrases_and_fewer_results(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert result(collocations.collocations(df, longest=5, least=4, top=7)) == brute([(x, t) for _, t, x in rows], 5, 4, 7)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Bits of rare phrases: all phrases pass, and the counts decide."""
    monkeypatch.setattr(collocations, "WORD_BITS", 6)
    monkeypatch.setattr(collocations, "PHRASE_BITS", 6)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert result(collocations.collocations(df)) == brute([(x, t) for _, t, x in rows])


def test_segments_give_the_same_lists():
    texts = [t.encode() for _, t, _ in corpus(6, 40)]
    whole = collocations.np.full(4, 2**64 - 1, dtype="uint64")
    for length in (1, 2, 3):
        parts = Counter()
        for some in (texts[:13], texts[13:]):
            names, of, start = collocations.Segment("en", some).lists(length, [whole, whole])
            assert (collocations.np.diff(start) > 0).all()
            parts.update({n: c for n, c in zip(names, collocations.np.bincount(of, minlength=len(names)).tolist(), strict=True) if c})
        want = Counter()
        for t in texts:
            for piece in re.split(rb"[.,;:!?\x0a-\x0d]", t.lower()):
                w = piece.split()
                want.update(b" ".join(w[i : i + length]) for i in range(len(w) - length + 1))
        assert parts == want


def test_large_numbers_are_exact(spark):
    """a * a * 1,000,000 far beyond 64 bits."""
    from lorescape.llm.shared import Scratch

    a, left, right = 9_000_000_000_000_007, 9_000_000_000_000_011, 9_000_000_000_000_013
    phrases = spark.createDataFrame([("en", "a b", a, 2), ("en", "a", left, 1), ("en", "b", right, 1)], "lang string, phrase string, f long, length int")
    with Scratch() as tables:
        (row,) = collocations.scored(phrases, tables).collect()
    assert row["score"] == 1_000_000 * a * a // (left * right)


def test_defined_cases(odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()]
    assert result(collocations.collocations(odd_docs)) == brute(rows)
    empty = collocations.collocations(no_docs)
    assert empty.count() == 0 and sorted(empty.columns) == sorted(COLUMNS)
