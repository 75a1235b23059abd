import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from lorescape.llm import toxicity
from tests.llm.conftest import prose

BAD = ["wretched", "vermin", "zounderkite", "gobermouch"]


def labelled(n):
    r = random.Random(9)
    rows = []
    for i in range(n):
        w = prose(2000 + i, 40).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int"), {i: x for i, _, x in rows}


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 90 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = toxicity.reject_toxic(docs, toxicity.train(docs, labels))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_held_out_labels_dont_matter(tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.ordinary, a.toxic, a.weights) == (b.ordinary, b.toxic, b.weights)


def long_texts(n):
    """Rows of labelled texts of more than 10,000 characters, the toxic words of which stand behind the first 10,000."""
    r = random.Random(10)
    rows = []
    for i in range(n):
        w = prose(5000 + i, 2200).split()
        if i % 2 == 0:
            for _ in range(8):
                w.insert(r.randrange(1900, len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), 1 - i % 2))
    return rows


def test_texts_are_learnt_from_to_their_end(spark, monkeypatch):
    rows = long_texts(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    held = [(scored[i]["predicted"], x) for i, _, x in rows if scored[i]["held_out"]]
    assert len(held) > 5 and sum(p == x for p, x in held) / len(held) > 0.9
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)  # of 1000 documents a class: about seven whole texts
    monkeypatch.setattr(toxicity, "fit", lambda *texts, odds: seen.extend(texts))
    toxicity.train(docs, labels)
    assert all(4 <= len(x) <= 10 and sum(map(len, x)) <= 100_000 and set(x) <= {t for _, t, _ in rows} for x in seen)


def test_lengths_and_scores_equal_another_computation(tables):
    """Window lengths by streaming compressors with both dictionaries, features and score by plain sums."""
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic + model.ordinary)]
    compressors = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in made]

    def length(c, data):
        o = c.compressobj()
        return len(o.compress(data) + o.flush())

    for r in toxicity.score_documents(docs, model).collect()[:60]:
        text = docs.where(docs.doc_id == r["doc_id"]).first()["text"] if r["doc_id"] < 8 else None
        if text is None:
            continue
        parts, rest = [], text.lower().encode()
        while rest:
            space = rest.find(b" ", toxicity.WINDOW, 2 * toxicity.WINDOW) if len(rest) > toxicity.WINDOW else len(rest)
            end = space if space >= 0 else toxicity.WINDOW
            parts.append(b" " + rest[:end].strip())
            rest = rest[end:]
        saved = [length(compressors[0], w) - length(compressors[1], w) for w in parts]
        hits = [sum(d >= t for d in saved) for t in model.thresholds]
        x = [math.log(1 + h) for h in hits] + [10 * h / len(saved) for h in hits] + [sum(saved) / len(saved), 1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True)))), abs=1e-12)


def test_dictionaries_are_trained_by_zstandard():
    toxic, ordinary = ([t for _, t, x in labelled(600) if x == y] for y in (1, 0))
    model = toxicity.fit(toxic, ordinary)
    for data, size in ((model.ordinary, toxicity.ORDINARY_BYTES), (model.toxic, toxicity.TOXIC_BYTES)):
        assert 200 < len(data) < size and toxicity.HEADER_END not in data  # the content without the trainer's header
    assert all(w.encode() in model.toxic for w in ("wretched", "zounderkite", "gobermouch")) and b"wretched" not in model.ordinary
    assert len(model.thresholds) == len(toxicity.RATES)


def test_telling_stretches_equal_counts_of_documents():
    toxic, ordinary = ([t for _, t, x in labelled(120) if x == y] for y in (1, 0))
    cut = [[toxicity.windows(t) for t in texts] for texts in (toxic, ordinary)]
    found = {int(g).to_bytes(8, "big") for g in toxicity.telling(*cut)}
    share = lambda g, docs: sum(any(g in w for w in d) for d in docs)
    m, n = map(len, cut)
    every = {w[i : i + 8] for d in cut[0] for w in d for i in range(len(w) - 7)}

    def ratio(g):
        x, y = share(g, cut[0]), share(g, cut[1])
        if x < 3 or x / m <= y / n:
            return 0
        both = (x + y) / (m + n)
        part = lambda k, of: sum(v * math.log(v / of / s) for v, s in ((k, both), (of - k, 1 - both)) if v)
        return 2 * (part(x, m) + part(y, n))

    ratios = {g: ratio(g) for g in every}
    assert found == {g for g, v in ratios.items() if v >= max(toxicity.LEAST, toxicity.EVIDENCE * max(ratios.values()))} and found
    assert toxicity.told(b" so wretched a thing", np.sort(np.frombuffer(b"".join(g[::-1] for g in (b"wretched", b" wretche")), dtype=np.uint64))) == [b" wretched"]


def test_thresholds_are_reached_by_their_share():
    d = np.array([0] * 900 + [1] * 60 + [2] * 25 + [4] * 12 + [9] * 3)
    assert toxicity.calibrated(d) == tuple(next(t for t in range(1, 99) if (d >= t).mean() <= rate) for rate in toxicity.RATES)
    assert toxicity.calibrated(d[:0]) == (1,) * len(toxicity.RATES)


def test_rows_without_an_id(spark, tables):
    docs, labels, _ = tables
    rows = toxicity.score_documents(spark.createDataFrame([(None, "plain text"), (None, None)], "doc_id long, text string"), toxicity.train(docs, labels)).collect()
    assert [(r["doc_id"], r["held_out"]) for r in rows] == [(None, False)] * 2
    assert spark.createDataFrame([(None,)], "doc_id long").select(toxicity.held_out().alias("h")).first()["h"] is False


def test_windows_cover_the_text():
    text = prose(3, 500) + "x" * 700
    assert b"".join(w.replace(b" ", b"") for w in toxicity.windows(text)) == text.replace(" ", "").encode()
    assert toxicity.windows("") == [] and len(toxicity.windows("ß" * 1000)) > 10


def test_odd_documents(tables, odd_docs, odd_texts, no_docs):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(odd_docs, model).collect()
    assert len(rows) == len(odd_texts) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert toxicity.score_documents(no_docs, model).count() == 0
    assert toxicity.reject_toxic(odd_docs, model).columns == odd_docs.columns
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_documents(odd_docs, none).collect()} == {0.0}
    few = toxicity.train(docs.where("doc_id < 9"), labels)
    assert toxicity.score_documents(odd_docs, few).count() == len(odd_texts) + 1
