"""Tables with what operators have to bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    base = prose(1)
    return [base, base, base.replace(" ", "  "), None, "", " \n\t ", "x", "ÄÖÜ ß Σ", "a" * 30_000, "1" * 20_000, "ab " * 8_000, prose(2), prose(1) + " end", prose(3) + "\n" + prose(1)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts with ids from 0, one row twice, and extra columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "en", "src0" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(odd_texts)]
    rows.append(rows[1])
    docs = spark.createDataFrame(rows, COLUMNS)
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(c) for c in ("score", "class_id", "spans", "digest", "key", "component", "n", "topic", "_bucket", "sketch", "p", "a", "b")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
