"""Text functions with the meaning that Unicode-aware scripts give them: stripping, lines, tokens, tags, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TOKEN = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def condensed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def lines(c: Column) -> Column:
    """The lines of a text without their ends; a final line end begins no line, and an empty text has none."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(query: str) -> list[str]:
    """Searchable tokens of a query, in lower case and order, repeats kept."""
    return re.findall(r"\w+", query.lower())


def distinct_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(tokens(query)))


def token_array(c: Column) -> Column:
    """The same for a column of queries."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def tag_list(c: Column) -> Column:
    """Tags of a comma-separated text."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def tag_text(c: Column) -> Column:
    """The text that stands for a list of tags in the index."""
    return F.array_join(c, ", ")


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def normalized_target(c: Column) -> Column:
    """A link target or document path as links are compared: slashes, no .md, no leading ./."""
    slashed = strip(F.replace(c, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(slashed, r"\.md$(?!\n)", ""), r"^\./", "")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def timestamp_text(c: Column) -> Column:
    """ISO 8601 in UTC to the second; the session's time zone has to be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def slug(c: Column) -> Column:
    """A project slug made of a name; null where none can be made."""
    made = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9._-]+", "-"), r"^[._-]+", "")
    return F.when(made.rlike(r"\A[a-z0-9][a-z0-9._-]*\z"), made)


def is_project_tag(c: Column) -> Column:
    return c.rlike(r"\Aproject:[a-z0-9][a-z0-9._-]*\z")


def coerced_count(c: Column) -> Column:
    """A stored count: what isn't a whole number, or is negative, counts as 0."""
    return F.greatest(F.coalesce(c.try_cast("long"), F.lit(0)), F.lit(0))


def estimated_tokens(chars: Column) -> Column:
    return F.floor(chars / 3.5).cast("long")


def truncated(c: Column, most: int) -> Column:
    """At most so many characters, cut at the last blank line, line end or space of the last two thirds if there is one."""
    head = F.substring(c, 1, most)

    def last(mark: str) -> Column:
        """0-based place of the last occurrence, -1 if there is none."""
        back = F.locate(mark[::-1], F.reverse(head))
        return F.when(back > 0, F.char_length(head) - back - len(mark) + 1).otherwise(-1)

    end = F.coalesce(*[F.when(last(m) >= most // 3, last(m)) for m in ("\n\n", "\n", " ")], F.char_length(head))
    cut = F.regexp_replace(F.substring(head, F.lit(1), end), rf"(?U){SPACE}+$", "")
    return F.when(F.char_length(c) <= most, c).otherwise(cut)


def without_header(c: Column, header: str = "Use this context before answering") -> Column:
    """A context's text without its first line if that is the header."""
    text = strip(c)
    rest = F.array_join(F.slice(lines(text), F.lit(2), F.greatest(F.size(lines(text)) - 1, F.lit(0))), "\n")
    return F.when(F.startswith(text, F.lit(header)), strip(rest)).otherwise(text)


def session_key(session_id: Column, cwd: Column) -> Column:
    """The name that a session's state is kept under: its id made safe, else a hash of its folder."""
    safe = F.regexp_replace(session_id, r"[^\p{L}\p{N}_-]", "_")
    return F.when(F.coalesce(session_id, F.lit("")) != "", safe).otherwise(F.substring(sha256(cwd), 1, 16))


#: Files whose change deserves a warning; fixed values.
SENSITIVE = ("schema.sql", "AGENTS.md", "config.toml", "settings.json", "Dockerfile", ".env")


def is_sensitive(path: Column) -> Column:
    out = F.lit(False)
    for part in SENSITIVE:
        out = out | F.contains(path, F.lit(part))
    return out


def under(path: Column, root: str) -> Column:
    """Whether a path is a folder or in it."""
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))
