"""Functions on text, Markdown and chunks, against small versions of their rules in Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lorescape.functions import chunking, markdown, text

SAMPLES = ["", " ", "\n", "a\r\nb\rc\x85d ", "  x　", "\x1c\x1dq\x1f", "é ß", "tail\n", "\n\nlead", "a\x0bb\x0cc"]


def column(spark, values, made, name="s"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["o"] for r in df.select("i", made(F.col(name)).alias("o")).orderBy("i").collect()]


def test_strip_lines_condense(spark):
    r = random.Random(1)
    values = SAMPLES + ["".join(r.choice("ab \t\n\r\x0b\x1c\x1e\x85  ") for _ in range(12)) for _ in range(200)]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.lines) == [v.splitlines() for v in values]
    assert column(spark, values, text.condensed) == [" ".join(v.split()) for v in values]


def test_tokens(spark):
    values = ["What? foo-bar", "한글 검색!", "a_b²½", ""]
    assert column(spark, values, text.token_array) == [text.tokens(v) for v in values]
    assert text.distinct_tokens("B a b A") == ["b", "a"]


def test_truncated(spark):
    def plain(t, n):
        if len(t) <= n:
            return t
        h = t[:n]
        for mark in ("\n\n", "\n", " "):
            if (at := h.rfind(mark)) >= n // 3:
                return h[:at].rstrip()
        return h.rstrip()

    r = random.Random(2)
    values = ["".join(r.choice("abcd \n") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["x" * 50]
    assert column(spark, values, lambda c: text.truncated(c, 30)) == [plain(v, 30) for v in values]


def test_small_ones(spark):
    assert column(spark, ["3", "-1", "corrupt", None, "4.5"], text.coerced_count) == [3, 0, 0, 0, 0]
    assert column(spark, ["./a\\b.md", " x.md ", "a/b", ".md"], text.normalized_target) == ["a/b", "x", "a/b", ""]
    assert column(spark, ["/a/b.c.md", "/x", "/.md"], text.stem) == ["b.c", "x", ".md"]
    assert column(spark, ["My Proj", "--", "._a!b"], text.slug) == ["my-proj", None, "a-b"]
    assert column(spark, ["project:a", "project:", "project:a\n", "Project:a"], text.is_project_tag) == [True, False, False, False]
    assert column(spark, ["Use this context before answering: x\nbody ", " plain "], text.without_header) == ["body", "plain"]
    assert column(spark, ["a/.env", "src/main.py"], text.is_sensitive) == [True, False]
    assert column(spark, ["/r", "/r/x", "/rx"], lambda c: text.under(c, "/r")) == [True, True, False]
    assert column(spark, ["a, b ,,c"], text.tag_list) == [["a", "b", "c"]]


RAW = {
    "---\ntitle: A: b\ntags: x, 'y z', \"w\"\n---\nbody\n": ("A: b", ["x", "y z", "w"], "body"),
    "---\ntags: [a, b]\nTITLE: t\n---\n\n# H\nb": ("t", ["a", "b"], "# H\nb"),
    "---\ntags:\n- a\n-  'b'\nother: x\n- c\n---\n# Head \nb": ("Head", ["a", "b"], "# Head \nb"),
    "---\ntitle: x\nno end": ("", [], "---\ntitle: x\nno end"),
    "# One\ntext": ("One", [], "# One\ntext"),
    "---\n---\n": ("", [], ""),
    "---\ntags: a\ntags: b\n---\nx": ("", ["b"], "x"),
    "plain": ("", [], "plain"),
    "": ("", [], ""),
    "---": ("", [], "---"),
    "---\ntags:\n---\nx": ("", [], "x"),
    "---\ntags: []\ntitle:\n---\n## no\n# yes": ("yes", [], "## no\n# yes"),
}


def test_frontmatter(spark):
    got = column(spark, list(RAW), markdown.parsed)
    assert [(r["title"], r["tags"], r["body"]) for r in got] == list(RAW.values())


def test_wikilinks(spark):
    values = ["[[a]] [[b|c]] [[a#x]] [[ ]] `[[no]]` [[d/e.md]]", "```\n[[no]]\n``` [[yes]]", "none [x]", "[[a\nb]]"]
    assert column(spark, values, markdown.wikilinks) == [["a", "b", "d/e.md"], ["yes"], [], ["a\nb"]]


def test_titles(spark):
    assert column(spark, ["my-note_3d", "it's"], markdown.title_case) == ["My Note 3D", "It'S"]


def test_tags_are_ensured_and_nothing_else_changes():
    raw = "---\nkey:   kept  \ntags: [a]\nz: 1\n---\nBody  \n\nend"
    once = markdown.tags_ensured(raw, ["p", "a"])
    assert once == "---\nkey:   kept  \ntags:\n  - a\n  - p\nz: 1\n---\nBody  \n\nend\n"
    assert markdown.tags_ensured(once, ["p"]) == once
    assert markdown.tags_ensured("# T\nx\n", ["p"]) == "---\ntitle: T\ntags:\n  - p\n---\n\n# T\nx\n"
    assert markdown.tags_ensured("---\na: b\n---\n", ["p"]) == "---\na: b\ntags:\n  - p\n---\n"


def test_managed_block(spark):
    put = lambda c: markdown.managed_block(c, "n", F.lit("x\ny"))
    block = "<!-- lorescape:n -->\nx\ny\n<!-- /lorescape:n -->"
    first = column(spark, ["a", "a\n\n", "a <!-- lorescape:n -->old<!-- /lorescape:n --> b"], put)
    assert first == [f"a\n\n{block}\n", f"a\n\n{block}\n", f"a {block} b\n"]
    assert column(spark, first, put) == first


# chunks


def plain_sections(body):
    out, stack, heading, held, fence = [], [], "", [], False

    def close():
        t = "\n".join(held).strip()
        if t:
            out.append((heading, t))

    for line in body.splitlines():
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        elif not fence and (m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)):
            close()
            held = []
            stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2])]
            heading = " > ".join(s[1] for s in stack)
            continue
        held.append(line)
    close()
    return out


def plain_chunks(body, cap):
    out = []
    for heading, t in plain_sections(body):
        prefix = heading + "\n\n" if heading else ""
        if len(prefix + t) <= cap:
            out.append((heading, prefix + t))
            continue
        budget = max(1, cap - len(prefix))
        now, parts = "", []
        for p in (x.strip() for x in re.split(r"\n\s*\n", t)):
            for piece in [p] if len(p) <= budget else [p[i : i + budget] for i in range(0, len(p), budget)]:
                if not piece:
                    continue
                longer = f"{now}\n\n{piece}" if now else piece
                if len(longer) <= budget:
                    now = longer
                else:
                    parts += [now] if now else []
                    now = piece
        out += [(heading, prefix + p) for p in parts + ([now] if now else [])]
    return out


def bodies():
    r = random.Random(3)
    bits = ["# One", "## Two ##", "### Three", "#### ", "#no", "```", "~~~", "text", "", "  ", "more text here", "# ", "x" * 50, "\t# indented"]
    return ["\n".join(r.choice(bits) for _ in range(r.randint(0, 20))) for _ in range(250)] + ["", "\n", "only", "# a\n# b", "pre\n# a\nx\n## b\ny\n### c\nz\n## d\nw"]


@pytest.mark.parametrize("cap", [1200, 60, 5])
def test_chunks_equal_plain_rules(spark, cap):
    values = bodies()
    got = column(spark, values, lambda c: chunking.chunks(c, cap))
    assert [[(c["heading"], c["text"]) for c in row] for row in got] == [plain_chunks(v, cap) for v in values]


def test_chunk_table(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies())], "doc_id long, body string")
    rows = chunking.chunk_table(df, 40).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r["ordinal"])
    assert all(sorted(o) == list(range(len(o))) for o in by_doc.values())
    a, b = chunking.chunk_table(spark.createDataFrame([(0, "# A\nsame"), (1, "# B\nsame")], "doc_id long, body string")).collect()
    assert a["content_hash"] != b["content_hash"]
