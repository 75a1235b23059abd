"""Markdown with frontmatter: parsing in one Arrow pass, links with built-in functions, and the rewriting of tags and managed blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lorescape.functions.text import strip

DELIMITER = "---"
LINK = r"\[\[([^\[\]]+?)\]\]"
FENCED, INLINE = r"(?s)```.*?```", r"`[^`\n]*`"


PARSED = pa.struct([("title", pa.string()), ("tags", pa.list_(pa.string())), ("body", pa.string())])


def front_and_rest(rows: list[str]) -> tuple[list[str] | None, list[str]]:
    """The lines of the frontmatter, or None if there is none or it doesn't end, and the lines behind it."""
    if rows and rows[0].strip() == DELIMITER:
        end = next((i for i, row in enumerate(rows[1:], 1) if row.strip() == DELIMITER), None)
        if end is not None:
            return rows[1:end], rows[end + 1 :]
    return None, rows


def front_fields(front: list[str]) -> dict[str, tuple[str, int]]:
    """The fields by lower-case key, each with its value and its line; the last one of a key counts."""
    split = ((row.partition(":"), i) for i, row in enumerate(front))
    return {key.strip().lower(): (value.strip(), i) for (key, colon, value), i in split if colon}


def tags_of(front: list[str]) -> list[str]:
    """The tags of the field of that name: a list on its line, or the "- " lines that follow an empty one."""
    value, at = front_fields(front).get("tags", ("[]", 0))
    if value:
        items = value.removeprefix("[").removesuffix("]").split(",")
    else:
        items = [x[2:] for x in takewhile(lambda x: x.startswith("- "), map(str.strip, front[at + 1 :]))]
    return [t for t in map(_bare, items) if t]


def heading_title(rows: list[str]) -> str:
    """The first line that begins with "# ", without it; empty if there is none."""
    return next((x.strip()[2:].strip() for x in rows if "# " in x and x.strip().startswith("# ")), "")


def document(raw: str) -> dict:
    """Title, tags and body of a Markdown text; the title is empty where only the file's name can give it."""
    rows = raw.splitlines()
    front, rest = front_and_rest(rows)
    named = front_fields(front).get("title", ("", 0))[0] if front is not None else ""
    body = raw if rest is rows and not (rows and rows[0].strip() == DELIMITER) else "\n".join(rest)
    return {"title": named or heading_title(rest), "tags": tags_of(front) if front is not None else [], "body": body.strip()}


@F.arrow_udf(StructType().add("title", StringType()).add("tags", ArrayType(StringType())).add("body", StringType()))
def parsed(raw: pa.Array) -> pa.Array:
    """document() for a column, in one pass over each text; null for null."""
    return pa.array([None if t is None else document(t) for t in raw.to_pylist()], PARSED)


@F.pandas_udf(StringType())
def title_case(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A file name's title; initcap() treats digits and apostrophes in another way."""
    for part in parts:
        yield part.map(lambda s: None if s is None else s.replace("-", " ").replace("_", " ").title())


def wikilinks(body: Column) -> Column:
    """Distinct link targets in the order of their first appearance; links in code don't count."""
    scrubbed = F.regexp_replace(F.regexp_replace(body, FENCED, " "), INLINE, " ")
    found = F.regexp_extract_all(scrubbed, F.lit(LINK), 1)
    targets = F.transform(found, lambda x: strip(F.substring_index(F.substring_index(x, "|", 1), "#", 1)))
    return F.array_distinct(F.filter(targets, lambda t: t != ""))


def managed_block(raw: Column, name: str, content: Column, owner: str = "lorescape") -> Column:
    """The text with the lines between a pair of markers replaced, or with markers and lines added at its end."""
    first, last = f"<!-- {owner}:{name} -->", f"<!-- /{owner}:{name} -->"
    block = F.concat(F.lit(first + "\n"), F.when(content == "", "").otherwise(F.concat(content, F.lit("\n"))), F.lit(last))
    text = F.when(F.endswith(raw, F.lit("\n")), raw).otherwise(F.concat(raw, F.lit("\n")))
    start, end = F.locate(first, text), F.locate(last, text)
    inside = F.concat(F.substring(text, F.lit(1), start - 1), block, F.substring(text, end + len(last), F.length(text)))
    gap = F.when(F.endswith(text, F.lit("\n\n")), "").otherwise("\n")
    return F.when((start > 0) & (end > start), inside).otherwise(F.concat(text, gap, block, F.lit("\n")))


def backlink_block(raw: Column, target: Column) -> Column:
    return managed_block(raw, "project-index", F.concat(F.lit("Related: [["), target, F.lit("]]")))


def _bare(tag: str) -> str:
    t = tag.strip()
    return t[1:-1].strip() if len(t) >= 2 and t[0] in "\"'" and t[0] == t[-1] else t


def tags_ensured(raw: str, required: Sequence[str]) -> str:
    """A text whose frontmatter lists its tags and the required ones, one a line; all its other lines stay as they are.

    A text without (complete) frontmatter gets one, with its heading as title.
    """
    rows = raw.removesuffix("\n").split("\n") if raw else []
    marks = [i for i, x in enumerate(rows) if x.strip() == DELIMITER]
    if marks[:1] == [0] and len(marks) > 1:
        head, rest = rows[1 : marks[1]], rows[marks[1] + 1 :]
    else:
        heading = next((x[2:].strip() for x in map(str.strip, rows) if x.startswith("# ")), "")
        head, rest = [f"title: {heading}"] * bool(heading), ["", *rows]
    fields = [x.partition(":") for x in head]
    at = next((i for i, (key, colon, _) in enumerate(fields) if colon and key.strip().lower() == "tags"), len(head))
    value = fields[at][2].strip() if at < len(head) else "none"
    items = [] if value else [*takewhile(lambda x: x.startswith("- "), map(str.strip, head[at + 1 :]))]
    inline = value.removeprefix("[").removesuffix("]").split(",") if at < len(head) else []
    tags = filter(None, map(_bare, [x[2:] for x in items] or inline))
    head[at : at + 1 + len(items)] = ["tags:", *(f"  - {t}" for t in dict.fromkeys([*tags, *required]))]
    return "\n".join([DELIMITER, *head, DELIMITER, *rest, ""])


@F.pandas_udf(StringType())
def with_tags(raw: pd.Series, required: pd.Series) -> pd.Series:
    """tags_ensured() for columns; each row has its own list of required tags."""
    return pd.Series([None if r is None else tags_ensured(r, list(q)) for r, q in zip(raw, required, strict=True)])
