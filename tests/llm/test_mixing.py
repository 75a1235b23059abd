import collections

import pytest
from pyspark.sql import functions as F

from lorescape.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(3000):
        source = "big" if i % 3 else f"s{i % 4}"
        rows.append((i, "w " * (1 + i % 17) + ("!!! " * (i * 7919 % 1009 % 3)), ["en", "de", None][i % 7 % 3], source, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_margins_reach_their_targets(docs):
    given = {"source": {"big": 0.4, "s0": 0.2, "s1": 0.2, "s2": 0.1, "s3": 0.1}, "lang": {"en": 0.5, "de": 0.3, "(none)": 0.2}}
    rows = mixing.mix(docs, given, budget=0.05, rounds=40).collect()
    for margin, shares in given.items():
        sums = collections.Counter()
        for r in rows:
            sums[r[margin]] += r["weight"]
        total = sum(sums.values())
        assert {k: round(v / total, 3) for k, v in sums.items()} == pytest.approx(shares, abs=2e-3)
    assert sum(r["weight"] for r in rows) == pytest.approx(0.05 * sum(r["n_tokens"] for r in rows), rel=1e-6)


def test_sampled_tokens_follow_the_budget(docs):
    rows = mixing.mix(docs, budget=0.2).collect()
    taken = sum(r["n_tokens"] for r in rows if r["sampled"]) / sum(r["n_tokens"] for r in rows)
    assert 0.17 < taken < 0.23 and max(r["probability"] for r in rows) <= 1
    shares = collections.Counter()
    for r in rows:
        shares[r["source"]] += r["weight"]
    assert shares["big"] / sum(shares.values()) < 0.6  # two thirds before


def test_margins_are_met_at_the_query_s_own_budget(spark, docs, caplog):
    """The limit of 1 is inside the fit; a budget that a value's tokens can't serve is lowered, and that is logged with the values."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rows in (mixing.mix(table), mixing.mix(docs)):
        got = mixing.achieved(rows)
        assert max(abs(share - target) for _, _, target, share in got) <= mixing.TOLERANCE, got
        assert 0 < rows.agg(F.sum("weight")).first()[0] <= mixing.BUDGET * rows.agg(F.sum("n_tokens")).first()[0] * 1.001
        assert rows.agg(F.max("probability")).first()[0] <= 1
    assert "instead of 0.5" in caplog.text and "topic symbols" in caplog.text


def test_largest_feasible_budget_is_taken():
    """Three cells: "a" has a tenth of the tokens and shall have half of the sample, so at most a fifth can be sampled."""
    counted = [{"source": "a", "lang": "x", "tokens": 10}, {"source": "b", "lang": "x", "tokens": 45}, {"source": "b", "lang": "y", "tokens": 45}]
    given = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.75, "y": 0.25}}
    budgets = [0.5 * (20 - j) / 20 for j in range(20)]
    p = mixing.fit_local(counted, ("source", "lang"), given, budgets, 300)
    assert p["a", "x"] == pytest.approx(1.0) and p["b", "x"] == pytest.approx(5 / 45) and p["b", "y"] == pytest.approx(5 / 45)
    assert mixing.fit_local([], ("source", "lang"), given, budgets, 3) == {}
    against = {"source": {"a": 1.0}, "lang": {"y": 1.0}}  # contradict each other: no cell has both
    assert max(mixing.fit_local(counted, ("source", "lang"), against, budgets, 20).values()) <= 1


def test_distributed_fit_equals_the_local_one(docs, no_docs):
    given = {"source": {"big": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}, "lang": {"en": 0.4, "de": 0.4, "(none)": 0.2}}
    few = docs.where("doc_id < 400")
    local, spread = ({r["doc_id"]: r["probability"] for r in mixing.mix(few, given, rounds=3, steps=2, most_cells=n).collect()} for n in (1000, 0))
    assert spread == pytest.approx(local, abs=1e-8)
    assert mixing.mix(no_docs, most_cells=-1).count() == 0


def test_zero_targets_and_saturation(docs):
    rows = mixing.mix(docs, {"source": {"s1": 1.0}, "lang": {}, "topic": {}}, budget=0.9).collect()
    assert all(r["probability"] == 0 for r in rows)  # no value of the other margins has a target
    rows = mixing.mix(docs, {"source": {"s1": 1.0}}, budget=0.9).collect()
    assert all((r["probability"] > 0) == (r["source"] == "s1") for r in rows)


def test_odd_documents(odd_docs, odd_texts, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 1
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == 0 and by_id[0]["lang"] == "(none)"
    assert mixing.mix(no_docs).count() == 0 and mixing.sample(no_docs).count() == 0
    kept = mixing.sample(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["sampled"]}


def test_topic_reads_the_whole_text(spark):
    df = spark.createDataFrame([("plain words only",), ("a, b. c! " * 3,), (None,), ("",), ("x" * 50_000 + "!" * 50_000,)], "text string")
    assert [r["t"] for r in df.select(mixing.topic(F.col("text")).alias("t")).collect()] == ["prose", "symbols", "prose", "prose", "symbols"]
