"""Each stage of the pipeline against a brute-force version of it, on what the stage before it kept."""

import collections
import hashlib
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorescape.llm import mixing, pii, queries, toxicity
from lorescape.llm.shared import table
from tests.llm.test_dart_minhash import brute
from tests.llm.test_spans import plain_pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives: name -> (rows before, rows after), and the columns of the table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out, before = docs.columns, {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        after = docs.collect()
        out[name] = (before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(after, docs.schema)
        before = after
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "pii", "mixing", "bpe"]


def test_toxic_documents_go_and_others_stay_as_they_are(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert sorted(after) == sorted(r for r in before if model.score(r["text"] or "") < 0.5)
    assert len(before) * 0.8 < len(after) < len(before)


def test_one_of_each_class_stays(stages):
    before, after = stages["near duplicates"]
    rows = sorted(before)
    label = brute([r["text"] for r in rows])  # of all pairs; the smallest place, so the smallest id
    assert sorted(after) == [r for i, r in enumerate(rows) if label[i] == i]
    assert len(after) < len(before)


def test_personal_data_is_replaced(stages):
    before, after = stages["pii"]
    by_id = {r["doc_id"]: r for r in after}
    assert len(before) == len(after) == len(by_id)
    changed = 0
    for r in before:
        text, spans = r["text"], sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_pii(r["text"])))
        spans += [(a, b, "iban") for a, b in pii.ibans(text) if any(s == a and pii.KINDS[k] == "iban" for s, k, *_ in pii.find(text))]
        out, at, end = "", 0, 0
        for a, b, kind in sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2]))):
            if a >= end:
                out += text[at:a] + f"[{kind.upper()}]"
            end = at = max(end, b)
        out += text[at:]
        changed += out != text
        assert by_id[r["doc_id"]] == r.__class__(*[out if c == "text" else len(out) if c == "n_chars" else r[c] for c in r.__fields__]), r["doc_id"]
    assert changed


def test_sample_is_decided_by_cell_and_id(stages):
    before, after = stages["mixing"]
    named = lambda r: (r["source"], r["lang"], topic(r["text"]))
    tokens = collections.Counter()
    for r in before:
        tokens[named(r)] += len(r["text"].split())
    counted = [dict(zip(mixing.MARGINS, k, strict=True), tokens=n) for k, n in tokens.items()]
    chance = mixing.fit_local(counted, mixing.MARGINS, {}, [mixing.BUDGET * (mixing.STEPS - j) / mixing.STEPS for j in range(mixing.STEPS)], mixing.ROUNDS)
    number = lambda r: int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32
    assert sorted(after) == sorted(r for r in before if number(r) < round(chance[named(r)], 9))
    assert 0 < len(after) < len(before)


def topic(text):
    share = sum("!" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~" for c in text) / len(text) if text else 0
    return next((name for least, name in mixing.TOPICS if share < least), mixing.TOPIC_REST)


def test_ids_equal_those_of_the_library(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for r in before:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in after} == want and len(after) == len(before)


def test_odd_documents(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in odd_docs.collect()}


def test_thirteen_queries():
    names = sorted(queries.queries(), key=lambda q: int(q[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
