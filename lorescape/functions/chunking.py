"""Chunks of a document: one for each section, under a path of headings, cut to a size.

The rule is sequential, line by line and then paragraph by paragraph, which nested array functions could only interpret at several times the
cost; so a body is cut in one pass over Arrow batches. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorescape.functions.text import sha256

CAP = 1200
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")
FENCES = ("```", "~~~")
BLANK = re.compile(r"\n\s*\n")
#: Between paragraphs of a chunk.
GAP = "\n\n"
#: Characters of a batch that Python gives back, in which each piece counts for so many besides its own.
BATCH_CHARS, PIECE = 1 << 21, 48
CHUNKS = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))


def sections(body: str) -> Iterator[tuple[str, str]]:
    """Sections that aren't empty, in order: (path of headings, body). What precedes the first heading has path ""."""
    above: list[tuple[int, str]] = []
    path, held, fenced = "", [], False

    for line in body.splitlines():
        if line.lstrip().startswith(FENCES):
            fenced = not fenced
        elif not fenced and line.startswith("#") and (found := HEADING.fullmatch(line)):
            if text := "\n".join(held).strip():
                yield path, text
            held = []
            level = len(found[1])
            while above and above[-1][0] >= level:
                above.pop()
            above.append((level, found[2]))
            path = " > ".join(title for _, title in above)
            continue
        held.append(line)
    if text := "\n".join(held).strip():
        yield path, text


def packed(body: str, budget: int) -> Iterator[str]:
    """Paragraphs packed greedily into pieces of at most so many characters; longer paragraphs are cut."""
    held, size = [], 0
    for paragraph in filter(None, map(str.strip, BLANK.split(body))):
        for at in range(0, len(paragraph), budget):
            piece = paragraph[at : at + budget]
            longer = size + len(GAP) + len(piece)
            if held and longer > budget:
                yield GAP.join(held)
                held = []
            size = longer if held else len(piece)
            held.append(piece)
    if held:
        yield GAP.join(held)


def cuts(body: str, cap: int = CAP) -> Iterator[tuple[str, list[str]]]:
    """Each section's heading and the pieces of its body, which with the heading before each have at most cap characters."""
    for heading, text in sections(body):
        prefix = len(heading) + len(GAP) if heading else 0
        yield heading, [text] if prefix + len(text) <= cap else list(packed(text, max(1, cap - prefix)))


def chunked(body: str, cap: int = CAP) -> list[dict[str, str]]:
    """All chunks of a body, whose texts begin with their heading and have at most cap characters."""
    return [{"heading": heading, "text": heading + GAP + p if heading else p} for heading, pieces in cuts(body, cap) for p in pieces]


def chunks(body: Column, cap: int = CAP) -> Column:
    """The same for a column: an array of (heading, text); null for null."""

    @F.arrow_udf("array<struct<heading:string,text:string>>")
    def cut(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else chunked(b, cap) for b in bodies.to_pylist()], CHUNKS)

    return cut(body)


def section_batches(batches: Iterable[pa.RecordBatch], cap: int, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """A row for each section of (doc_id, body): doc_id, ordinal of its first chunk, heading, pieces; of about so many characters a batch."""
    for batch in batches:
        ids, bodies = batch.columns
        held, size = [], 0

        def made() -> pa.RecordBatch:
            at, starts, headings, pieces = zip(*held, strict=True)
            return pa.record_batch([ids.take(pa.array(at)), pa.array(starts, pa.int32()), pa.array(headings, pa.string()), pa.array(pieces, pa.list_(pa.string()))], ["doc_id", "start", "heading", "pieces"])

        for i, body in enumerate(bodies):
            start = 0
            for heading, pieces in cuts(body.as_py() or "", cap):
                held.append((i, start, heading, pieces))
                start += len(pieces)
                size += len(heading) + sum(map(len, pieces)) + PIECE * len(pieces)
                if size >= most:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()


def chunk_table(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """A row for each chunk: doc_id, ordinal, heading, text, content_hash.

    A path of headings can be longer than the cap, so that each character of the section becomes a chunk with all of the path before it: hundreds of
    times the text. So Python gives the heading once and the bare pieces, and the texts are put together row by row.
    """
    kind = T.StructType([documents.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("pieces", T.ArrayType(T.StringType()))])
    found = documents.select("doc_id", "body").mapInArrow(lambda batches: section_batches(batches, cap), kind)
    rows = found.select("doc_id", "start", "heading", F.posexplode("pieces").alias("at", "piece"))
    text = F.when(F.col("heading") == "", F.col("piece")).otherwise(F.concat("heading", F.lit(GAP), "piece"))
    rows = rows.select("doc_id", (F.col("start") + F.col("at")).alias("ordinal"), "heading", text.alias("text"))
    return rows.withColumn("content_hash", sha256(F.col("text")))
