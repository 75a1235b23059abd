"""Chunks whose headings are longer than the cap: hundreds of times the text."""

from __future__ import annotations

from lorescape.functions import chunking


def received(plan) -> int:
    """Bytes that Python gave back for a plan that has run."""
    own = plan.metrics()
    return (own.apply("pythonDataReceived").value() if own.contains("pythonDataReceived") else 0) + sum(received(plan.children().apply(i)) for i in range(plan.children().size()))


def test_long_headings_come_back_once(spark):
    head, body = "h" * 3000, "".join(chr(97 + i % 26) for i in range(2000))
    df = spark.createDataFrame([(1, f"# {head}\n{body}\n\n## {head}\nxyz"), (2, None), (3, ""), (4, "none\n# t\na")], "doc_id long, body string").coalesce(1)
    made = chunking.chunk_table(df)
    rows = made.orderBy("doc_id", "ordinal").collect()
    twice = f"{head} > {head}"
    want = [(1, i, head, f"{head}\n\n{c}") for i, c in enumerate(body)] + [(1, 2000 + i, twice, f"{twice}\n\n{c}") for i, c in enumerate("xyz")]
    want += [(4, 0, "", "none"), (4, 1, "t", "t\n\na")]
    assert [(r["doc_id"], r["ordinal"], r["heading"], r["text"]) for r in rows] == want
    assert len(made.collect()) == len(want)
    assert 0 < received(made._jdf.queryExecution().executedPlan()) < 200_000


def test_section_batches_are_bounded():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(50)), pa.array([f"# {'h' * 2000}\n{'x' * 2000}"] * 50)], ["doc_id", "body"])
    made = list(chunking.section_batches([batch], chunking.CAP, 300_000))
    assert len(made) > 10 and all(b.nbytes < 500_000 for b in made)
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(50))
