"""The index as a log of segments: what a change writes, what a search reads, several writers, and runs that are killed."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from lorescape.engine import Engine
from lorescape.errors import WarehouseError
from lorescape.operators import blocks, lexical, links, postings, store
from lorescape.plans.search import search
from lorescape.segments import Store

INCOMING = "path string, title string, tags array<string>, body string"


def engine(spark, where, fan=8, **more) -> Engine:
    made = Engine(spark, str(where), **more)
    made.store = Store(spark, str(where), fan=fan)
    return made


def notes(spark, *rows):
    return spark.createDataFrame([(p, p.rsplit("/")[-1], ["en"], b) for p, b in rows], INCOMING)


def size(folder) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def same_as_made_anew(e: Engine) -> None:
    """All tables equal what the documents alone give."""
    documents = e.table("documents")
    rows = lambda df: sorted(map(str, df.collect()))
    chunks, edges = store.derived(documents)
    assert rows(e.table("chunks")) == rows(chunks) and rows(e.table("links")) == rows(edges)
    assert rows(e.table("postings")) == rows(postings.pairs(documents))
    assert rows(e.edges()) == rows(links.resolved(edges, documents).select("source_id", "ordinal", "target", "dst_id"))
    whole = postings.lengths(documents).first()
    assert e.table("lengths").first()["documents"] == whole["documents"]
    assert (e.table("lengths").first()["mean_length"] or 0) == pytest.approx(whole["mean_length"] or 0)
    assert rows(e.table("paths").select("doc_id", "path")) == rows(documents.select("doc_id", "path"))


def test_any_changes_give_the_tables_of_the_last_documents(spark, tmp_path):
    r = random.Random(3)
    e, kept = engine(spark, tmp_path / "w", fan=2), {}
    names = [f"/{d}/{n}.md" for d in ("a", "a/b", "c") for n in ("x", "y", "index", "z")]
    for _ in range(4):
        fresh = {p: f"{r.choice(['uranium', 'thorium'])} {r.randint(0, 3)} [[{r.choice(['x', 'b/x', 'index', 'a/z.md', 'none', './y'])}]] [[{r.choice('xyz')}]]" for p in r.sample(names, 4)}
        e.add(notes(spark, *fresh.items()))
        kept |= fresh
        lost = r.sample(sorted(kept), 2)
        e.delete(e.table("paths").where(F.col("path").isin(lost)))
        for p in lost:
            del kept[p]
        assert {x["path"]: x["body"] for x in e.table("documents").collect()} == kept
    same_as_made_anew(e)
    ids = [x["doc_id"] for x in e.table("documents").collect()]
    assert len(ids) == len(set(ids))
    before = len(e.store.state().segments)
    e.vacuum()
    same_as_made_anew(e)
    assert len(e.store.state().segments) == before < 40


def test_a_changed_file_writes_in_proportion_to_itself(spark, tmp_path):
    root = tmp_path / "notes"
    r = random.Random(1)
    for i in range(10_000):
        (root / f"d{i % 20}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 20}/n{i}.md").write_text(f"# note {i}\n\n" + " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(60)) + f" [[n{(i * 7) % 10_000}]]")
    e = Engine(spark, str(tmp_path / "w"))
    assert e.reindex(str(root)).first()["indexed"] == 10_000
    whole = size(tmp_path / "w")
    (root / "d3/n3.md").write_text("# note 3\n\nplutonium [[n5]]")
    assert e.reindex(str(root)).first().asDict() == {"indexed": 10_000, "deleted": 0, "failed": 0}
    assert size(tmp_path / "w") - whole < 60_000 < whole / 20
    assert [x["path"] for x in e.search("plutonium").collect()] == [str(root / "d3/n3.md")]
    number = e.store.state().number
    e.reindex(str(root))
    assert e.store.state().number == number  # nothing differs, nothing is written
    written = [s["rows"] for s in e.store.state().of("targets")]
    assert written == [10_000]  # the new text names nothing that hasn't been named before, and no other link is looked at


def test_searches_read_only_files_with_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lorescape.segments.BLOCK_ROWS", 40)
    monkeypatch.setattr("lorescape.segments.SHIFT", 5)
    e = Engine(spark, str(tmp_path / "w"))
    e.add(notes(spark, *[(f"/n/{i:04}.md", f"common words {'plutonium core' if i in (311, 312) else 'number'} {i}") for i in range(1000)]))
    e.add(notes(spark, ("/n/0312.md", "plutonium moved"), ("/n/2000.md", "a second plutonium core")))
    state = e.store.state()
    known, rows = blocks.matching(e.store, state, ["plutonium", "core"])
    files = rows.inputFiles()
    everything = e.table("documents").inputFiles()
    assert len([f for f in files if "/documents/" in f]) <= 3 and len([f for f in everything if "/documents/" in f]) >= 25
    assert known == lexical.statistics(e.table("documents"), ["plutonium", "core"])
    for q in ("plutonium core", "common", "words 31", "core number", "com", "nothing here", "zzz", "of"):
        assert e.search(q, 7).collect() == search(e.table("documents"), q, 7, chunks=e.table("chunks")).collect(), q


def test_two_writers_both_land(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    a.add(notes(spark, ("/a.md", "first [[x]]"), ("/b.md", "second")))
    plain, waiting = a.store.commit, [notes(spark, ("/c.md", "third"), ("/d.md", "fourth"))]

    def late(change):
        if waiting and change.adds:
            b.add(waiting.pop())  # between the writing of a's change and its commit
        return plain(change)

    a.store.commit = late
    a.add(notes(spark, ("/e.md", "fifth"), ("/b.md", "renewed")))
    assert not waiting
    rows = {x["path"]: (x["doc_id"], x["body"]) for x in a.table("documents").collect()}
    assert {p: t for p, (_, t) in rows.items()} == {"/a.md": "first [[x]]", "/b.md": "renewed", "/c.md": "third", "/d.md": "fourth", "/e.md": "fifth"}
    assert len({i for i, _ in rows.values()}) == 5
    same_as_made_anew(a)


def test_writers_of_one_document_follow_each_other(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    a.add(notes(spark, ("/a.md", "first [[x]]"), ("/b.md", "second")))
    plain = a.store.commit
    waiting = [lambda: b.add(notes(spark, ("/a.md", "b's text"), ("/q/x.md", "b's x"))), lambda: b.delete(b.table("paths").where("path = '/b.md'"))]

    def late(change):
        if waiting and change.adds:
            waiting.pop(0)()
        return plain(change)

    a.store.commit = late
    a.add(notes(spark, ("/a.md", "a's text [[x]]"), ("/p/x.md", "a's x")))
    rows = {x["path"]: x["body"] for x in a.table("documents").collect()}
    assert rows == {"/a.md": "a's text [[x]]", "/q/x.md": "b's x", "/p/x.md": "a's x"}
    same_as_made_anew(a)


def test_too_many_writers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.add(notes(spark, ("/a.md", "first")))
    e.store.name = lambda state: (_ for _ in ()).throw(WarehouseError("taken"))
    with pytest.raises(WarehouseError, match="too many"):
        e.record([1])


class Noting:
    """Vectors of one number; writes down what it was asked for."""

    def __init__(self, path):
        self.path = path

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.writelines(t.splitlines()[-1] + "\n" for t in texts)
        return [[float(len(t))] for t in texts]


def test_a_killed_run_embeds_only_the_rest(spark, tmp_path):
    asked = tmp_path / "asked"
    made = lambda: engine(spark, tmp_path / "w", provider=Noting(str(asked)), model="m", round_size=20)
    e = made()
    e.add(notes(spark, *[(f"/{i}.md", f"text {i}") for i in range(100)]))
    plain, left = e._round, [3]

    def killed(texts):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        return plain(texts)

    e._round = killed
    with pytest.raises(KeyboardInterrupt):
        e.embed()
    first = asked.read_text().split("\n")[:-1]
    assert 20 < len(first) < 90 and made().table("embeddings").count() == len(first)
    report = made().embed().first()
    assert (report["embedded"], report["reused"], report["failed"], report["reason"]) == (100 - len(first), len(first), 0, None)
    assert sorted(asked.read_text().split("\n")[:-1]) == sorted(f"text {i}" for i in range(100))  # each once
    assert made().embed().first()["reused"] == 100


def test_pruned_vectors_can_come_back(spark, tmp_path):
    e = engine(spark, tmp_path / "w", provider=Noting(str(tmp_path / "asked")), model="m")
    for text, want in (("one", 1), ("two", 1), ("one", 1)):
        e.add(notes(spark, ("/a.md", text)))
        assert e.refresh_embeddings().first()["embedded"] == 1
        assert e.table("embeddings").count() == want
    assert (tmp_path / "asked").read_text() == "one\ntwo\none\n"


def test_usage_of_deleted_documents_goes(spark, tmp_path):
    e = engine(spark, tmp_path / "w", fan=2)
    e.add(notes(spark, ("/a.md", "one"), ("/b.md", "two")))
    for i in (1, 2, 2, 2):
        e.record([i])
    e.add(notes(spark, ("/b.md", "another text")))  # keeps its counts
    e.delete(e.table("paths").where("path = '/a.md'"))
    assert [(x["doc_id"], x["retrieved_count"]) for x in e.table("usage").collect()] == [(2, 3)]
