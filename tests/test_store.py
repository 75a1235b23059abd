"""Keeping the index: files, upserts, deletions, links, vault, sessions, streams, and the engine as a whole."""

from __future__ import annotations

import itertools
import json
import random
import shutil
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lorescape.engine import Engine
from lorescape.errors import ColumnTypeError, ConfigReadError, DocumentNotFoundError, EmbeddingBackendError, VaultError, WarehouseError
from lorescape.operators import links, semantic, sessions, store, usage, vault
from lorescape.schemas import checked
from lorescape.sources import config, console, embedding, json_files, markdown
from lorescape.streaming.dedup import deduplicated, retrievals_by_time
from lorescape.streaming.watch import Watcher

DOCS = "doc_id long, path string, title string, tags array<string>, body string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, p, "t", [], b) for i, p, b in rows], DOCS)


# links


def plain_resolve(target, paths):
    w = target.replace("\\", "/").strip().removesuffix(".md").removeprefix("./")
    if not w:
        return None
    known = sorted((i, p.removesuffix(".md")) for i, p in paths.items())
    for i, p in known:
        if p == w or p.endswith("/" + w):
            return i
    return next((i for i, p in known if p.rsplit("/", 1)[-1] == w.rsplit("/", 1)[-1]), None)


def test_link_resolution_equals_nested_loop(spark):
    r = random.Random(1)
    parts = ["a", "b", "c", "note", "x.md"]
    paths = {i: "/" + "/".join(r.choice(parts) for _ in range(r.randint(1, 4))) + ".md" for i in range(1, 40)}
    targets = ["/".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(200)] + ["", "./a", "a\\b", "zz", "A", " note.md ", "/a"]
    table = docs(spark, *[(i, p, "") for i, p in paths.items()])
    edges = links.resolved(spark.createDataFrame([(1, i, t) for i, t in enumerate(targets)], "source_id long, ordinal int, target string"), table)
    got = {r["ordinal"]: r["dst_id"] for r in edges.collect()}
    assert got == {i: plain_resolve(t, paths) for i, t in enumerate(targets)}


def test_link_graph(spark):
    table = docs(spark, (1, "/v/a.md", "[[b]] [[v/b.md]] [[a]] [[gone]]"), (2, "/v/b.md", "[[a]]"), (3, "/v/c.md", "[[gone]] [[lost]]"))
    edges = links.resolved(store.link_table(table), table)
    pairs = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert pairs(links.graph_edges(edges), "source_id", "dst_id") == [(1, 2), (1, 2), (2, 1)]
    assert pairs(links.outgoing(edges, 1), "dst_id", "ordinal") == [(2, 0)]
    assert pairs(links.backlinks(edges, 1), "source_id") == [(2,)]
    assert pairs(links.unresolved(edges), "target") == [("gone",), ("lost",)]
    assert pairs(links.orphans(table, edges), "doc_id") == [(3,)]


# tables


def test_upsert_keeps_ids_and_numbers_by_parts(spark):
    old = docs(spark, (1, "/a.md", "x"), (7, "/b.md", "y"))
    new = spark.createDataFrame([("/b.md", "t", ["z"], "new"), ("/d/a-b.md", "t", [], ""), ("/d/a/b.md", "t", [], "")], "path string, title string, tags array<string>, body string")
    got = {r["path"]: (r["doc_id"], r["body"]) for r in store.upserted(old, new).collect()}
    assert got == {"/a.md": (1, "x"), "/b.md": (7, "new"), "/d/a/b.md": (8, ""), "/d/a-b.md": (9, "")}
    again = store.upserted(store.upserted(old, new), new)
    assert {r["path"]: r["doc_id"] for r in again.collect()} == {p: v[0] for p, v in got.items()}


def test_vectors_are_kept_by_hash(spark):
    chunks = spark.createDataFrame([(1, 0, "", "a", "ha"), (2, 0, "", "a", "ha"), (3, 0, "", "b", "hb")], "doc_id long, ordinal int, heading string, text string, content_hash string")
    vectors = spark.createDataFrame([("ha", "m", 1, [1.0]), ("old", "m", 1, [1.0]), ("hb", "n", 1, [1.0])], "content_hash string, model string, dimension int, vector array<float>")
    assert [r["content_hash"] for r in semantic.pending(chunks, vectors, "m").collect()] == ["hb"]
    fresh = semantic.succeeded(semantic.embedded(semantic.pending(chunks, vectors, "m"), embedding.HashProvider(4), "m"))
    after = semantic.stored(vectors, fresh)
    assert semantic.accounting(chunks, vectors, after, "m").first().asDict() == {"embedded": 1, "reused": 1, "failed": 0}
    assert {r["content_hash"] for r in semantic.pruned(after, chunks).collect()} == {"ha", "hb"}
    states = {r["model"]: r["state"] for r in semantic.coverage(chunks, semantic.pruned(after, chunks)).collect()}
    assert states == {"m": "full", "n": "partial"}

    class Broken:
        def embed(self, texts):
            raise EmbeddingBackendError("down")

    outcome = semantic.embedded(semantic.pending(chunks, vectors, "m"), Broken(), "m")
    assert semantic.succeeded(outcome).count() == 0 and semantic.reason(outcome).first()["reason"] == "down"


class Shaky:
    """Fails for batches with certain texts, in two ways."""

    def embed(self, texts):
        if "text 64" in texts:
            raise ConnectionResetError("reset")
        if "text 128" in texts:
            raise EmbeddingBackendError("refused")
        return [[1.0]] * len(texts)


def test_batches_behind_a_failed_one_are_embedded(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{i}", f"text {i}") for i in range(300)], "content_hash string, text string").coalesce(1)
    outcome = semantic.embedded(rows, Shaky(), "m")
    good = {r["content_hash"] for r in semantic.succeeded(outcome).collect()}
    assert good == {f"h{i}" for i in range(300) if not 64 <= i < 192}
    assert semantic.reason(outcome).first()["reason"] == "refused"
    e = Engine(spark, str(tmp_path / "w"), Shaky(), "m")
    e.add(spark.createDataFrame([("/a.md", "a", [], "text 64"), ("/b.md", "b", [], "other")], "path string, title string, tags array<string>, body string").coalesce(1))
    report = e.embed().first()
    assert report["failed"] + report["embedded"] == 2 and (report["reason"] == "reset") == (report["failed"] > 0)


def test_schemas_are_checked(spark):
    assert checked(docs(spark, (1, "/a", "")).withColumn("more", F.lit(1)), "documents").columns == ["doc_id", "path", "title", "tags", "body"]
    with pytest.raises(ColumnTypeError, match="documents.doc_id"):
        checked(spark.range(1), "documents")


# vault


def test_three_way_actions(spark):
    cases = {"new": (None, None), "same": ("r", "x"), "ours": ("l", "l"), "edited": ("e", "l"), "foreign": ("e", None)}
    entries = spark.createDataFrame([(f"s{t}", t, "s", "r", "create", "", "") for t in cases] + [("own", "own", "s", "r", "create", "", "")], "source string, target string, source_sha256 string, rendered_sha256 string, action string, rendered string, conflict_reason string")
    current = spark.createDataFrame([(t, c) for t, (c, _) in cases.items() if c] + [("own", "e")], "target string, sha256 string")
    owned = spark.createDataFrame([(t, x) for t, (_, x) in cases.items() if x], "target string, last_sha string")
    got = {r["target"]: (r["action"], r["conflict_reason"]) for r in vault.with_actions(entries, current, owned).collect()}
    assert got == {"new": ("create", ""), "same": ("unchanged", ""), "ours": ("update", ""), "edited": ("conflict", "locally-modified"), "foreign": ("conflict", "unmanaged"), "own": ("update", "")}
    counts = {r["action"]: r["entries"] for r in vault.action_counts(vault.with_actions(entries, current, owned)).collect()}
    assert counts == {"create": 1, "update": 2, "unchanged": 1, "conflict": 2}


def test_sources_are_checked():
    assert vault.parse_source(" a = /x ") == ("a", "/x")
    for bad in ("a", "=x", "a="):
        with pytest.raises(VaultError):
            vault.parse_source(bad)
    with pytest.raises(VaultError):
        vault.checked_sources([("a", "/x"), ("a", "/y")])
    with pytest.raises(VaultError):
        vault.checked_sources([("A b", "/x")])


def test_notes_hub_and_index(spark):
    files = spark.createDataFrame([("p", "x.md", "body"), ("p", "d/y.md", "---\ntags: a\n---\nb\n")], "slug string, relative string, raw string")
    notes = vault.rendered_notes(files)
    texts = {r["relative"]: r["rendered"] for r in notes.collect()}
    assert "  - a\n  - project:p" in texts["d/y.md"] and "Related: [[projects/p/index]]" in texts["x.md"]
    hub = vault.hubs(notes, spark.createDataFrame([("p", None)], "slug string, raw string")).first()["rendered"]
    assert "- [[projects/p/d/y]]\n- [[projects/p/x]]" in hub and "# p Project Index" in hub
    index = vault.global_index(spark.createDataFrame([("projects/p/index",)], "link string"), None).first()["rendered"]
    assert index.startswith("# Global Index") and "- [[projects/p/index]]" in index
    assert vault.global_index(spark.createDataFrame([("projects/p/index",)], "link string"), index).first()["rendered"] == index


def test_manifests(spark, tmp_path):
    entries = spark.createDataFrame([("s", "t", "1", "2", "create", "text", "")], "source string, target string, source_sha256 string, rendered_sha256 string, action string, rendered string, conflict_reason string")
    first = json_files.write_manifest(tmp_path, entries, "planned")
    assert json_files.write_manifest(tmp_path, entries, "applied", first) == first
    second = json_files.write_manifest(tmp_path, entries.withColumn("rendered_sha256", F.lit("3")), "applied")
    json_files.write_manifest(tmp_path, entries.withColumn("rendered_sha256", F.lit("4")), "planned")
    (tmp_path / "broken.json").write_text("{")
    assert second > first
    assert [(r["target"], r["last_sha"]) for r in vault.owned_state(json_files.manifest_entries(spark, str(tmp_path))).collect()] == [("t", "3")]


def test_lists_in_parts_are_the_whole_texts(spark):
    r = random.Random(6)
    notes = spark.createDataFrame([(s, f"projects/{s}/{r.randrange(500)}") for s, n in (("big", 300), ("p", 4), ("q", 5)) for _ in range(n)], "slug string, link string")
    bases = spark.createDataFrame([("big", None), ("p", "---\ntitle: x\n---\n<!-- lorescape:notes -->\nold\n<!-- /lorescape:notes -->\nbehind\n"), ("q", "# own"), ("none", None)], "slug string, raw string")
    whole = {x["slug"]: x["rendered"] for x in vault.hubs(notes, bases).collect()}
    for lines in (1, 4, 1000):
        parts = vault.hub_parts(notes, bases, lines).orderBy("slug", "part").collect()
        got = {s: "".join(x["text"] for x in rows) for s, rows in itertools.groupby(parts, key=lambda x: x["slug"])}
        assert got == whole and max(x["text"].count("[[") for x in parts) <= lines


# sessions


def events(n=200):
    r = random.Random(4)
    return [(f"s{r.randrange(5)}", i, float(i * 100 + r.randrange(50)), r.choice("ab"), r.randrange(1, 9), 0.0) for i in range(n)]


EVENTS = "session_id string, event_id long, ts double, context_hash string, context_len long, index_mtime double"


def replayed(rows, ttl):
    state, out = {}, {}
    for s, i, ts, h, n, _ in rows:
        last = state.get(s)
        dup = last is not None and last[0] == h and ts - last[1] <= ttl
        state[s] = (h, ts, last[2] if dup else n)
        out[i] = dup
    return out


def test_marking_equals_replay(spark):
    rows = events()
    got = {r["event_id"]: r["duplicate"] for r in sessions.marked(spark.createDataFrame(rows, EVENTS), 450).collect()}
    assert got == replayed(rows, 450) and 20 < sum(got.values()) < 180


def test_stream_equals_replay(spark, tmp_path):
    rows = events()
    for k, part in enumerate(itertools.batched(rows, 60)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = deduplicated(stream, 450).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r["event_id"]: r["duplicate"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    if got != replayed(rows, 450):  # files of one second may be read in another order
        assert sum(got.values()) > 20


def test_windowed_retrievals(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), 1) for m in (1, 5, 59)] + [(datetime(2024, 1, 1, 5), 2)], "ts timestamp, doc_id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, doc_id long").parquet(f"{tmp_path}/in")
    q = retrievals_by_time(s).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["retrievals"] for r in spark.table("windows").collect()) == [1, 3]


def test_gates_and_totals(spark):
    long = "Use this context before answering\n" + "word " * 40
    rows = [("s", 1, "hi", long), ("s", 2, "ok?", "short"), ("s", 3, "what", long), ("s", 4, "what", "No context found")]
    got = sessions.gated(spark.createDataFrame(rows, "session_id string, event_id long, prompt string, context string")).collect()
    assert [r["event_id"] for r in got] == [3]
    stats = sessions.statistics(spark.createDataFrame([("a", True, 5), ("a", True, 5), ("b", True, 9), ("c", False, 9)], "session_id string, duplicate boolean, context_len long"))
    assert {r["session_id"]: r["saved_tokens"] for r in stats.collect()} == {"a": 2, "b": 2, "c": 0}
    assert sessions.totals(stats).first().asDict() == {"sessions": 3, "dedup_hits": 3, "saved_chars": 19, "saved_tokens": 5}
    assert [r["session_id"] for r in sessions.shown(stats).collect()] == ["a", "b"]


def test_state_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "a", "dedup_hits": 3, "saved_chars": "bad", "updated_at": 1.5}))
    (tmp_path / "b.json").write_text("not json")
    (r,) = json_files.session_states(spark, str(tmp_path)).collect()
    assert (r["session_id"], r["dedup_hits"], r["saved_chars"]) == ("a", 3, 0)


# settings and servers


def test_settings(tmp_path, monkeypatch):
    for k in ("WAREHOUSE", "EMBED_MODEL", "EMBED_ENDPOINT", "EMBED_DIMENSION", "EMBED_ALLOW_REMOTE"):
        monkeypatch.delenv("LORESCAPE_" + k, raising=False)
    monkeypatch.setenv("LORESCAPE_HOME", str(tmp_path / "home"))
    project = tmp_path / "p" / ".lorescape"
    project.mkdir(parents=True)
    file = project / "config.toml"
    file.write_text('mode = "isolated"\nwarehouse = "w"\nproject = "mine"\n[embedding]\nmodel = "m"\ndimension = 8\n')
    inside = tmp_path / "p" / "deep"
    inside.mkdir()
    assert config.warehouse(start=inside) == str(project / "w") and config.project(inside) == "project:mine"
    monkeypatch.setenv("LORESCAPE_WAREHOUSE", "/env")
    assert config.warehouse(start=inside) == "/env" and config.warehouse("/given", inside) == "/given"
    monkeypatch.delenv("LORESCAPE_WAREHOUSE")
    file.write_text(file.read_text().replace('warehouse = "w"\n', ""))
    with pytest.raises(ConfigReadError, match="warehouse"):
        config.warehouse(start=inside)  # an isolated project without one
    file.write_text('warehouse = "w"\n' + file.read_text().replace("isolated", "global"))
    home = tmp_path / "home"
    assert config.warehouse(start=inside) == str(home / "warehouse")  # a global project has none of its own
    home.mkdir()
    (home / "config.toml").write_text('warehouse = "shared"\n')
    assert config.warehouse(start=inside) == str(home / "shared") == config.warehouse(start=tmp_path)
    (home / "config.toml").unlink()
    monkeypatch.setenv("LORESCAPE_EMBED_ENDPOINT", "http://example.org/v1")
    s = config.embedding(inside)
    assert (s.model, s.dimension, s.is_blocked) == ("m", 8, True) and embedding.loaded(s) is None
    monkeypatch.setenv("LORESCAPE_EMBED_ALLOW_REMOTE", "yes")
    assert embedding.loaded(config.embedding(inside)) is not None
    file.write_text("= broken")
    with pytest.raises(ConfigReadError):
        config.project(inside)
    assert config.embedding(tmp_path) is None or config.embedding(tmp_path).model


def test_endpoints_and_replies():
    s = lambda e, **k: embedding.Settings("m", e, **k)
    assert s("http://localhost:1/v1").url == "http://localhost:1/v1/embeddings"
    assert s("http://localhost:1/").url == "http://localhost:1/api/embed"
    assert s("http://localhost:1", api="OpenAI").url == "http://localhost:1/v1/embeddings"
    assert s("http://localhost:1/x/embed").url == "http://localhost:1/x/embed"
    for bad in (None, "ftp://h"):
        with pytest.raises(EmbeddingBackendError):
            _ = s(bad).url
    assert embedding.shown("https://u:p@h:1/x?token=1#f") == "https://h:1/x"
    assert "u:p" not in embedding.described(s("http://u:p@example.org/x")) and "blocked" in embedding.described(s("http://example.org"))
    assert embedding.vectors_of({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}) == [[1.0], [2.0]]
    assert embedding.vectors_of({"embeddings": [[1, 2.5]]}) == [[1.0, 2.5]]
    for bad in ([], {}, {"embeddings": [["x"]]}, {"data": [{"index": 0}]}):
        with pytest.raises(EmbeddingBackendError):
            embedding.vectors_of(bad)


def test_http_provider():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            seen.append(len(texts))
            body = json.dumps({"data": [{"index": i, "embedding": [len(t), 1]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = embedding.Settings("m", f"http://127.0.0.1:{server.server_port}/v1")
    texts = ["x" * i for i in range(70)]
    assert embedding.HttpProvider(s).embed(texts) == [[float(i), 1.0] for i in range(70)] and seen == [32, 32, 6]
    with pytest.raises(EmbeddingBackendError):
        embedding.HttpProvider(embedding.Settings("m", s.endpoint, dimension=3)).embed(["a"])
    server.shutdown()


# files and the engine


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    for name, text in {"a.md": "# Alpha\n\nuranium [[b]] [[nowhere]]", "d/b.md": "---\ntitle: Beta\ntags: [project:p, x]\n---\nplutonium text", ".hid/c.md": "x", "node_modules/d.md": "x", "e.txt": "x", "d/.f.md": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out.md").write_text("secret")
    (root / "link.md").symlink_to(tmp_path / "out.md")
    return root


def test_scan(spark, notes):
    good, failed = markdown.documents(markdown.files(spark, str(notes)))
    assert {r["path"].removeprefix(str(notes)): (r["title"], r["tags"]) for r in good.collect()} == {"/a.md": ("Alpha", []), "/d/b.md": ("Beta", ["project:p", "x"])}
    assert [r["path"].rsplit("/")[-1] for r in failed.collect()] == ["bad.md"]


def test_engine(spark, notes, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w", embedding.HashProvider(32), "m")
    assert e.reindex(str(notes)).first().asDict() == {"indexed": 2, "deleted": 0, "failed": 1}
    first = {r["path"].rsplit("/")[-1]: r["doc_id"] for r in e.table("documents").collect()}
    assert first == {"a.md": 1, "b.md": 2}
    assert [r["doc_id"] for r in e.search("plutonium").collect()] == [2]
    assert [r["dst_id"] for r in e.outgoing(1).collect()] == [2] and [r["source_id"] for r in e.backlinks(2).collect()] == [1]
    assert e.document_chunks(1).count() == 1 and e.document_chunks(99).count() == 0
    with pytest.raises(DocumentNotFoundError):
        e.document(99)
    with pytest.raises(ValueError):
        e.search("x", limit=21)
    e.ask_context("uranium", now=datetime(2026, 1, 1, tzinfo=UTC))
    e.record([1, 1])
    assert [(r["doc_id"], r["retrieved_count"]) for r in e.usage_report().collect()][0] == (1, 3)
    (notes / "a.md").write_text("# Alpha\n\nthorium")
    (notes / "d/b.md").unlink()
    assert e.reindex(str(notes)).first()["deleted"] == 1
    assert e.search("uranium").where("false").count() == 0 and e.search("thorium").first()["doc_id"] == 1
    assert e.search("plutonium").where("doc_id = 2").count() == 0
    assert e.table("embeddings").count() == 1
    e.vacuum()
    assert "full" in " ".join(r["state"] for r in e.doctor().collect())
    block = console.context_block(e.search("thorium")).first()["context"]
    assert block.startswith(console.HEADER) and "thorium" in block
    assert console.context_block(e.search("zzzz").where("false")).first()["context"] == "No context found"


def test_watch(spark, notes):
    changes = []
    w = Watcher(spark, str(notes), lambda df: changes.extend((r["path"].rsplit("/")[-1], r["change"]) for r in df.collect()))
    assert not w.poll()
    (notes / "new.md").write_text("n")
    (notes / "d/b.md").unlink()
    assert w.poll() and sorted(changes) == [("b.md", "deleted"), ("new.md", "added")]
    assert not w.poll()

    def fail(_):
        raise RuntimeError("busy")

    w.on_change = fail
    (notes / "newer.md").write_text("n")
    with pytest.raises(RuntimeError):
        w.poll()
    changes.clear()
    w.on_change = lambda df: changes.extend(r["change"] for r in df.collect())
    assert w.poll() and changes == ["added"]  # the change is seen again


def test_a_watcher_takes_over_changed_files_alone(spark, notes, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.reindex(str(notes))
    w = Watcher(spark, str(notes), lambda changes: e.follow(str(notes), changes))
    (notes / "new.md").write_text("neptunium")
    (notes / "a.md").write_text("# Alpha\n\nthorium")
    (notes / "d/b.md").unlink()
    assert w.poll() and not w.poll()
    assert {r["path"].removeprefix(str(notes)): r["body"] for r in e.table("documents").collect()} == {"/a.md": "# Alpha\n\nthorium", "/new.md": "neptunium"}
    assert [s["rows"] for s in e.store.state().of("documents")] == [2, 2] and e.table("embeddings").count() == 0


def test_links_and_deep_folders(spark, tmp_path):
    """A file has one path whatever links lead to it; links out of the root and links to folders aren't followed."""
    root = tmp_path / "r"
    deep = root / "a/b/c/d/e"
    deep.mkdir(parents=True)
    (deep / "x.md").write_text("deep")
    (root / "top.md").write_text("top")
    (root / ".store").mkdir()
    (root / ".store/kept.md").write_text("kept")
    (root / "a/alias.md").symlink_to(deep / "x.md")
    (root / "a/kept.md").symlink_to(root / ".store/kept.md")
    (root / "again").symlink_to(root / "a")
    (tmp_path / "out.md").write_text("out")
    (root / "a/out.md").symlink_to(tmp_path / "out.md")
    (root / "a/lost.md").symlink_to(tmp_path / "nowhere.md")
    found = {r["path"].removeprefix(str(root)): bytes(r["content"]) for r in markdown.files(spark, str(root)).collect()}
    assert found == {"/a/b/c/d/e/x.md": b"deep", "/top.md": b"top", "/.store/kept.md": b"kept"}


def test_names_that_spark_hides_are_found(spark, tmp_path):
    root = tmp_path / "r"
    for name in ("a.md", "_b.md", "_drafts/c.md", "d/_e.md", ".hidden/_f.md", "node_modules/_g.md", "_x.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}")
    found = {r["relative"]: (r["path"], bytes(r["content"])) for r in markdown.files(spark, str(root)).collect()}
    assert found == {n: (str(root / n), f"# {n}".encode()) for n in ("a.md", "_b.md", "_drafts/c.md", "d/_e.md")}
    e = Engine(spark, str(tmp_path / "w"))
    spelled = f"{root}/d/../../r"
    (tmp_path / "link").symlink_to(root)
    assert [e.reindex(x).first().asDict() for x in (str(root), spelled, f"{tmp_path}/link")] == [{"indexed": 4, "deleted": 0, "failed": 0}] * 3
    assert e.table("documents").count() == 4
    (root / "_b.md").unlink()
    assert e.reindex(str(root)).first()["deleted"] == 1


def test_a_change_of_tables_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "w"))
    row = lambda body: spark.createDataFrame([("/a.md", "a", ["t"], body)], "path string, title string, tags array<string>, body string")
    e.add(row("first [[b]]"))
    state = lambda: (e.table("documents").first()["body"], [r["target"] for r in e.table("links").collect()], e.table("chunks").first()["text"])
    before = state()

    class Stop(Exception):
        pass

    real = type(row("").write).parquet

    def killed(self, path, *a, **b):
        if "/links/" in path:
            raise Stop
        return real(self, path, *a, **b)

    monkeypatch.setattr(type(row("").write), "parquet", killed)
    with pytest.raises(Stop):
        e.add(row("second [[c]]"))
    monkeypatch.undo()
    assert state() == before == ("first [[b]]", ["b"], "first [[b]]")
    e.add(row("second [[c]]"))
    assert state() == ("second [[c]]", ["c"], "second [[c]]")
    e.vacuum()
    assert state() == ("second [[c]]", ["c"], "second [[c]]")
    with pytest.raises(WarehouseError):  # another writer was faster
        e.store.name(e.store.state())
    shutil.rmtree(tmp_path / "w" / "manifests")
    with pytest.raises(WarehouseError):  # a lost manifest isn't an empty index
        e.table("documents")


def test_repeated_paths_and_lines(spark, tmp_path):
    new = spark.createDataFrame([("/a.md", t, [], b) for t, b in (("x", "1"), ("y", "0"), ("y", "2"))], "path string, title string, tags array<string>, body string")
    none = spark.createDataFrame([], "doc_id long, path string, title string, tags array<string>, body string")
    assert [(r["title"], r["body"]) for r in store.upserted(none, new).collect()] == [("y", "2")]
    e = Engine(spark, str(tmp_path / "w"))
    e.add(spark.createDataFrame([("/a.md", "A", [], "[[b]] [[c]]"), ("/b.md", "B", [], "[[a]]"), ("/c.md", "C", [], "")], "path string, title string, tags array<string>, body string"))
    found = console.link_lines(e.outgoing(1), e.backlinks(1), e.table("documents")).orderBy("kind", "place").collect()
    assert [r["line"] for r in found] == ["<- [2] B (/b.md)", "-> [2] B (/b.md)", "-> [3] C (/c.md)"]
    e.record([3, 3], datetime(2026, 1, 2, 3, 4))
    shown = console.usage_split_lines(usage.split_lists(e.usage_report(), 20)).orderBy("kind", "place").collect()
    assert [(r["kind"], r["line"]) for r in shown] == [("never", "[1] A"), ("never", "[2] B"), ("retrieved", "2 x [3] C, 2026-01-02 03:04")]


def test_reports(spark):
    table = docs(spark, (1, "/a", ""), (2, "/b", ""), (3, "/c", ""))
    log = spark.createDataFrame([(2, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2)), (9, datetime(2026, 1, 1))], "doc_id long, retrieved_at timestamp")
    counts = usage.counted(log)
    report = usage.report(table, counts)
    assert [r["doc_id"] for r in usage.in_order(report).collect()] == [2, 1, 3]
    assert usage.totals(report).first().asDict() == {"documents": 3, "never_retrieved": 2}
    assert usage.without_orphans(counts, table).count() == 1
    assert usage.recorded(counts, log).where("doc_id = 2").first()["retrieved_count"] == 4


def test_vault_import(spark, tmp_path):
    from lorescape.sources import vault_files

    home, src = tmp_path / "home", tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "a.md").write_text("# A\ntext\n")
    (src / "d/b.md").write_text("---\ntags: x\n---\nb\n")
    home.mkdir()
    actions = lambda: {r["target"].removeprefix(str(home)): r["action"] for r in vault_files.plan(spark, str(home), [("p", str(src))]).collect()}
    first = vault_files.plan(spark, str(home), [("p", str(src))])
    assert set(actions().values()) == {"create"} and len(actions()) == 4
    vault_files.apply(first, str(home))
    hub = (home / "docs/projects/p/index.md").read_text()
    assert "- [[projects/p/a]]\n- [[projects/p/d/b]]" in hub
    assert set(actions().values()) == {"unchanged"} and not (home / vault_files.STAGING).exists()
    (src / "a.md").write_text("# A\nnew\n")
    assert actions()["/docs/projects/p/a.md"] == "update"
    (home / "docs/projects/p/a.md").write_text("edited by hand")
    assert actions()["/docs/projects/p/a.md"] == "conflict"
    with pytest.raises(VaultError):
        vault_files.apply(vault_files.plan(spark, str(home), [("p", str(src))]), str(home))


@pytest.mark.parametrize("renamed", range(4))
def test_a_vault_import_that_is_cut_off_is_finished(spark, tmp_path, monkeypatch, renamed):
    from lorescape.sources import vault_files

    home, src = tmp_path / "home", tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\r\ntext\n")
    (src / "b.md").write_text("# B\n")
    home.mkdir()
    plain, left = vault_files._rename, [renamed]

    def killed(*a):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        plain(*a)

    monkeypatch.setattr(vault_files, "_rename", killed)
    with pytest.raises(KeyboardInterrupt):
        vault_files.apply(vault_files.plan(spark, str(home), [("p", str(src))]), str(home))
    monkeypatch.undo()
    there = lambda: {str(p.relative_to(home)) for p in (home / "docs").rglob("*.md")}
    assert len(there()) == renamed
    (home / vault_files.STAGING / "left-by-a-run-that-never-planned").mkdir()
    if renamed == 0:  # somebody writes a target meanwhile: nothing of it is lost
        (home / "docs/projects/p").mkdir(parents=True)
        (home / "docs/projects/p/a.md").write_text("by hand")
        with pytest.raises(VaultError, match="a.md"):
            vault_files.recover(str(home))
        assert (home / "docs/projects/p/a.md").read_text() == "by hand"
        (home / "docs/projects/p/a.md").unlink()
    assert vault_files.recover(str(home)) == ["000001.json"] and vault_files.recover(str(home)) == []
    assert there() == {"docs/index.md", "docs/projects/p/index.md", "docs/projects/p/a.md", "docs/projects/p/b.md"} and not (home / vault_files.STAGING).exists()
    assert {r["action"] for r in vault_files.plan(spark, str(home), [("p", str(src))]).collect()} == {"unchanged"}


def test_sessions_end_and_their_state_goes(spark, tmp_path):
    import time

    from lorescape.streaming.dedup import ended

    rows = [(f"s{i % 3}", i, float(i), "h", 5, 0.0) for i in range(30)]
    for k, part in enumerate(itertools.batched(rows, 10)):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = deduplicated(stream, 450, keep=20).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    most, until = 0, time.time() + 240
    while time.time() < until:
        state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        most = max([most, *state])
        if most == 3 and state[-1] == 0:
            break
        time.sleep(1)
    q.stop()
    assert most == 3 and state[-1] == 0
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("event_id is not null").count() == 30
    assert sorted(tuple(r) for r in ended(out).collect()) == [(f"s{i}", 9, 45) for i in range(3)]


def test_postings_are_kept_and_searched(spark, tmp_path):
    """After each change the engine's results equal those of a scan, and only documents that hold all trigrams are read."""
    from lorescape.plans.search import search

    e = Engine(spark, str(tmp_path / "w"))
    columns = "path string, title string, tags array<string>, body string"
    corpus = [(f"/n/{i}.md", f"note {i}", ["en"], f"reactor {'fuel rod' if i % 3 else 'coolant'} number {i} " * (1 + i % 4)) for i in range(30)]

    def same():
        for q in ("reactor fuel", "coolant", "zzzz", "of", "note 7"):
            scan = search(e.table("documents"), q, 5, chunks=e.table("chunks")).collect()
            assert e.search(q, 5).collect() == scan, q
        n = e.table("documents").count()
        assert e.table("lengths").first()["documents"] == n and e.table("postings").select("doc_id").distinct().count() == n
        assert e.table("postings").count() == e.table("postings").distinct().count()

    e.add(spark.createDataFrame(corpus, columns))
    same()
    e.add(spark.createDataFrame([(p, t, g, "new text about coolant" if i % 2 else b) for i, (p, t, g, b) in enumerate(corpus)], columns))
    same()
    gone = e.table("documents").where("doc_id % 4 = 0")
    e._change(spark.createDataFrame([], columns), gone)
    same()
    assert e.table("postings").where("gram = 'fue'").count() == e.table("documents").where("contains(body, 'fuel')").count()
