"""The passage of a document that answers a query best: its chunk with most distinct tokens, cut around the first one.

A document without chunks is quoted as the full-text index would quote it: the window of its body with most distinct phrases. Either
is made for the documents that are shown, no others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescape.functions.text import condensed

CHARS, LEAD = 220, 40
#: Trigrams of a window, and what stands for text that is left out.
GRAMS, LEFT_OUT = 18, " ... "
#: What the first occurrence of a phrase counts in a window, a repeated one counting 1, and what a window gains that begins the text or a sentence.
FRESH, OPENING, SENTENCE = 1000, 120, 100
SENTENCE_END = re.compile(r"[.:][ \t\n\r]+")
#: Code points before the first phrase in a fixed window, and all of them.
FIXED_LEAD, FIXED = 6, 20


def matched(text: Column, tokens: Sequence[str]) -> Column:
    """How many of the tokens a text holds."""
    out = F.lit(0)
    for t in tokens:
        out = out + F.contains(F.lower(text), F.lit(t)).cast("int")
    return out


def best_chunks(chunks: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Each document's chunk with most tokens, the earliest of equal ones: doc_id, heading, text."""
    key = F.struct(matched(F.col("text"), tokens), -F.col("ordinal"))
    return chunks.groupBy("doc_id").agg(F.max_by(F.struct("heading", "text"), key).alias("c")).select("doc_id", "c.heading", "c.text")


def excerpt(body: Column, tokens: Sequence[str]) -> Column:
    """A window of CHARS characters on one line that begins LEAD before the first token."""
    line = condensed(body)
    places = [F.nullif(F.instr(F.lower(line), t), F.lit(0)) for t in tokens]
    first = F.array_min(F.array(*places)) - 1 if places else F.lit(None).cast("int")
    start = F.when(first.isNull() | (F.char_length(line) <= CHARS), 0).otherwise(F.greatest(F.lit(0), first - LEAD))
    window = F.substring(line, start + 1, F.lit(CHARS))
    return F.concat(F.when(start > 0, "... ").otherwise(""), window, F.when(start + CHARS < F.char_length(line), " ...").otherwise(""))


def rendered(heading: Column, text: Column, tokens: Sequence[str]) -> Column:
    """A chunk's excerpt behind its heading."""
    bare = F.when((heading != "") & F.startswith(text, heading), F.substring(text, F.char_length(heading) + 1, F.char_length(text))).otherwise(text)
    return F.when(heading == "", excerpt(text, tokens)).otherwise(F.concat(heading, F.lit(" — "), excerpt(bare, tokens)))


def _folded(text: str) -> str:
    """The text in lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def _places(text: str, phrase: str) -> Iterator[int]:
    at = text.find(phrase)
    while at >= 0:
        yield at
        at = text.find(phrase, at + 1)


def quoted(text: str, phrases: Sequence[str]) -> str:
    """The window of GRAMS trigrams that SQLite's snippet() takes from a text for these phrases, on both sides of which others may be left out.

    For each occurrence two windows are weighed: the one that begins there, which is then moved until its phrases lie in the middle, and the one that
    begins with the sentence. The first of the best wins; a text without any of the phrases is quoted from its beginning. Place i
    is that of the trigram which begins with code point i.
    """
    size = max(0, len(text) - 2)
    folded = _folded(text)
    hits = sorted((at, k) for k, p in enumerate(phrases) for at in _places(folded, p))
    starts = [0, *(i for m in SENTENCE_END.finditer(text) for i in range(m.start() + 2, m.end() + 1))]

    def inside(start: int) -> list[tuple[int, int]]:
        return hits[bisect_left(hits, (start,)) : bisect_left(hits, (start + GRAMS,))]

    def worth(found: list[tuple[int, int]]) -> int:
        fresh = len({k for _, k in found})
        return FRESH * fresh + len(found) - fresh

    best, start = 0, 0
    for at, _ in hits:
        found = inside(at)
        if worth(found) > best:
            last, k = found[-1]
            span = last + len(phrases[k]) - 2 - at
            best, start = worth(found), max(0, min(at - int((GRAMS - span) / 2), size - GRAMS))
        sentence = starts[bisect_right(starts, at) - 1]
        if size > GRAMS and sentence < at:
            gain = SENTENCE if sentence else OPENING
            if worth(inside(sentence)) + gain > best:
                best, start = worth(inside(sentence)) + gain, sentence
    whole = start + GRAMS >= size
    return (LEFT_OUT if start else "") + (text[start:] if whole else text[start : start + GRAMS + 2] + LEFT_OUT)


def body_snippet(body: Column, phrases: Sequence[str]) -> Column:
    """What stands for a document without chunks: its window; phrases are the query's searchable tokens, repeats kept."""
    wanted = list(phrases)

    @F.arrow_udf("string")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([quoted(b or "", wanted) for b in bodies.to_pylist()], pa.string())

    return run(body)


def fixed_window(body: Column, phrases: Sequence[str]) -> Column:
    """A plainer window that SQL can state, for callers that ask for it: FIXED code points of the body on one line, from FIXED_LEAD before the first phrase."""
    line = F.trim(F.regexp_replace(body, r"[\t\n\f\r ]+", " "))
    places = [F.nullif(F.instr(F.lower(line), p), F.lit(0)) for p in phrases]
    first = F.array_min(F.array(*places)) - 1 if places else F.lit(0)
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - FIXED_LEAD)
    window = F.substring(line, start + 1, F.lit(FIXED))
    return F.concat(F.when(start > 0, LEFT_OUT).otherwise(""), window, F.when(start + FIXED < F.char_length(line), LEFT_OUT).otherwise(""))
