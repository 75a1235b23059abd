"""Search against SQLite's full-text index, an implementation of its own, and the rules on scope, usage and fusion."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorescape.errors import ProjectScopeError
from lorescape.operators import lexical, scope, semantic, snippets
from lorescape.plans.search import search, window

DOCS = "doc_id long, path string, title string, tags array<string>, body string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"/{i}.md", t, g, b) for i, t, g, b in rows], DOCS)


def ids(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("query", ["tion shed", "aaa", "tion of tion", "ing", "nothing_here", "한국어"])
def test_bm25_equals_sqlite(spark, query):
    rows = [(i, f"title {i} tion", ["tag", "ing"] if i % 3 else [], ("tion shed ing " * (i % 5) + "aaaa " * (i % 4) + "filler words " * i)) for i in range(1, 40)]
    rows.append((40, "한국어 문서", [], "본문"))
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(title, body, tags, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no trigram index")
    db.executemany("insert into f(rowid, title, body, tags) values (?, ?, ?, ?)", [(i, t, b, ", ".join(g)) for i, t, g, b in rows])
    terms = " ".join(f'"{t}"' for t in lexical.tokens(query))
    want = db.execute("select rowid, -bm25(f) from f where f match ? order by 2 desc, 1 limit 15", (terms,)).fetchall()
    got = lexical.best(corpus(spark, rows), query, 15).collect()
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert [r["bm25"] for r in got] == pytest.approx([w[1] for w in want], rel=1e-9)


def test_short_tokens_and_blank_queries(spark):
    df = corpus(spark, [(1, "ab", [], "ab cd")])
    for q in ("ab", "", "  ", "?!"):
        assert search(df, q).count() == 0


def test_windows():
    assert window(5, False, False) == 5 and window(5, False, True) == 20 and window(9, False, True) == 36 and window(5, True, True) is None


def test_scope(spark):
    rows = [(i, "t", ["project:other"], "wanted wanted wanted") for i in range(15)]
    rows += [(15, "t", ["project:mine"], "wanted and much other text besides"), (16, "t", [], "wanted text"), (17, "t", ["project:minebar"], "wanted")]
    df = corpus(spark, rows)
    assert set(ids(search(df, "wanted", 5, project="mine"))) == {15, 16}
    assert ids(search(df, "wanted", 5, tags=["project:mine", " "])) == [15]
    assert len(ids(search(df, "wanted", 5, tags=[" "]))) == 5
    with pytest.raises(ProjectScopeError):
        scope.project_tag("No Slug")
    assert scope.project_tag("project:a") == scope.project_tag(" a ")


def test_drafts_come_last_but_come(spark):
    df = corpus(spark, [(1, "t", ["draft"], "alpha alpha alpha"), (2, "t", [], "alpha and lots of other words here"), (3, "t", [], "beta")])
    assert ids(search(df, "alpha")) == [2, 1]


def test_min_score_and_ties(spark):
    df = corpus(spark, [(2, "t", [], "gamma"), (1, "t", [], "gamma"), (3, "t", [], "other"), (4, "t", [], "other")])
    assert ids(search(df, "gamma")) == [1, 2]
    assert search(df, "gamma", min_score=99.0).count() == 0


def test_usage_lifts_a_tie(spark):
    df = corpus(spark, [(1, "t", [], "gamma"), (2, "t", [], "gamma"), (3, "t", [], "x"), (4, "t", [], "y"), (5, "t", [], "z")])
    used = spark.createDataFrame([(2, 5)], "doc_id long, retrieved_count long")
    assert ids(search(df, "gamma", usage=used)) == [1, 2]
    assert ids(search(df, "gamma", usage=used, usage_weight=0.3)) == [2, 1]


def plain_rrf(lex, sem, limit):
    pool = list(lex) + [d for d in sem if d not in lex]
    n = len(pool)
    lr, sr = {d: i for i, d in enumerate(pool)}, {d: i for i, d in enumerate(sem)}
    score = {d: 1 / (60 + (lex.index(d) if d in lex else n)) + 1 / (60 + sr.get(d, n)) for d in pool}
    return sorted(pool, key=lambda d: (-score[d], lr[d]))[:limit]


@pytest.mark.parametrize("scoped", [False, True])
def test_fusion(spark, scoped):
    rows = [(i, "t", [], "delta " * (30 - i) + "pad " * i * 3) for i in range(1, 30)] + [(i, "t", [], "nothing alike") for i in range(100, 106)] + [(200, "t", ["project:no"], "nothing")]
    df = corpus(spark, rows)
    sem = [103, 200, 7, 29, 100]
    hits = spark.createDataFrame([(d, i) for i, d in enumerate(sem)], "doc_id long, sem_rank int")
    lex = [r["doc_id"] for r in lexical.best(df, "delta", 20 if not scoped else 1000).collect()]
    got = ids(search(df, "delta", 5, hits=hits, project="p" if scoped else None))
    if scoped:  # ranks keep the gap of the document that is out of scope
        n = len(lex) + 2
        sr = {d: i for i, d in enumerate(sem)}
        score = {d: 1 / (60 + (lex.index(d) if d in lex else n)) + 1 / (60 + sr.get(d, n)) for d in [*lex, 103, 100]}
        assert got == sorted(score, key=lambda d: (-score[d], lex.index(d) if d in lex else 1000 + sr[d]))[:5]
    else:
        assert got == plain_rrf(lex, sem, 5)


def test_an_equal_fused_score_goes_to_the_lexical_one(spark):
    df = corpus(spark, [(5, "t", [], "omega"), (1, "t", [], "else"), (6, "t", [], "else")])
    hits = spark.createDataFrame([(1, 0)], "doc_id long, sem_rank int")
    assert ids(search(df, "omega", hits=hits)) == [5, 1]
    assert ids(search(df, "omega", hits=hits.where("false"))) == [5]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [-1.0, 0.0])], "doc_id long, vector array<float>")
    got = semantic.nearest(v, [0.0, 2.0]).collect()
    assert [(r["doc_id"], round(r["sim"], 6), r["sem_rank"]) for r in got] == [(2, 1.0, 0), (1, 0.8, 1)]


def test_snippets(spark):
    long = "lead " * 60 + "needle " + "tail " * 60
    chunks = spark.createDataFrame([(1, 0, "", "intro"), (1, 1, "H", "H\n\n" + long), (1, 2, "H", "H\n\nneedle")], "doc_id long, ordinal int, heading string, text string")
    best = snippets.best_chunks(chunks, ["needle"])
    (r,) = best.select(snippets.rendered(F.col("heading"), F.col("text"), ["needle"]).alias("s")).collect()
    line = " ".join(long.split())
    start = line.index("needle") - 40
    assert r["s"] == "H — ... " + line[start : start + 220] + " ..."
    df = corpus(spark, [(1, "t", [], "needle in text"), (2, "t", [], "no chunk: needle")])
    got = {x["doc_id"]: x["snippet"] for x in search(df, "needle", chunks=chunks).collect()}
    assert got[1].startswith("H — ") and "needle" in got[2]


def test_quotes_equal_sqlite(spark):
    """Windows of bodies as SQLite's snippet() cuts them: sentences, repeats, overlaps, long phrases, ends, other scripts."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(title, body, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no trigram index")
    r = random.Random(3)
    words = ["tion", "Shed", "ing", "Nation", "stations", "한국어 문서", "Éclair", "x", "internationalisation", "end.", "note:", ".", "a.b", "\n", "\t", "  "]
    bodies = ["", "ab", "tion", "a tion", "no match at all. " * 4, "TION" * 30, "one: two. tion", ".  tion shed", "tion" + " x" * 40 + " shed"]
    bodies += [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(400)]
    queries = ["tion", "tion shed", "ation", "nation ation", "shed tion shed", "éclair", "한국어", "internationalisation ing", "ing tion nation stations"]
    for q in queries:
        phrases = lexical.searchable(q)
        db.execute("delete from f")
        # every title holds all phrases, so that bodies without them are quoted, too
        db.executemany("insert into f(rowid, title, body) values (?, ?, ?)", [(i, q, b) for i, b in enumerate(bodies)])
        want = dict(db.execute("select rowid, snippet(f, 1, '', '', ' ... ', 18) from f where f match ?", (" ".join(f'"{p}"' for p in phrases),)))
        assert len(want) == len(bodies)
        assert {i: snippets.quoted(b, phrases) for i, b in enumerate(bodies)} == want
    df = spark.createDataFrame(list(enumerate([*bodies[:20], None])), "doc_id long, body string")
    got = {x["doc_id"]: x["s"] for x in df.select("doc_id", snippets.body_snippet(F.col("body"), phrases).alias("s")).collect()}
    assert got == {i: want[i] for i in range(20)} | {20: ""}
    # neighbours that share characters but no trigram, where some versions of SQLite repeat text
    assert snippets.quoted("b " * 30 + "aaaa" + " c" * 30, ["aaa"]) == " ... b b b b aaaa c c c c ... "


def test_vector_hits_without_chunks_quote_nothing(spark):
    df = corpus(spark, [(1, "t", [], "omega in the text"), (2, "t", [], "else")])
    hits = spark.createDataFrame([(2, 0)], "doc_id long, sem_rank int")
    assert {x["doc_id"]: x["snippet"] for x in search(df, "omega", hits=hits).collect()} == {1: "omega in the text", 2: ""}


def test_postings_equal_a_scan(spark):
    from lorescape.operators import postings

    rows = [(i, f"title {i}", ["tag"] * (i % 2), "tion shed " * (i % 4) + "Ünï ing " * (i % 3) + "hed she ion") for i in range(1, 50)]
    df = corpus(spark, rows)
    index = postings.postings(df).cache()
    for q in ("tion shed", "ünï", "tag ing", "zzz", "ab", "shed tion shed"):
        want = [(r["doc_id"], round(r["bm25"], 9)) for r in lexical.best(df, q, 9).collect()]
        got = postings.best(df, index, postings.lengths(df), q, 9).collect()
        assert [(r["doc_id"], round(r["bm25"], 9)) for r in got] == want
