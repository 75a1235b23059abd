"""The vault: copies of projects' notes under a common home, kept by a three-way comparison so that no edit is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescape.errors import VaultError
from lorescape.functions.markdown import backlink_block, managed_block, with_tags
from lorescape.functions.text import under
from lorescape.operators import links as graph
from lorescape.operators.scope import SLUG
from lorescape.operators.store import placed

ACTIONS = ("create", "update", "unchanged", "conflict")
GLOBAL_INDEX = "# Global Index\n"
#: Lines of a part of a long list, and what holds its place in the text around it.
PART_LINES, SPOT = 10_000, "\x00list\x00"


def parse_source(spec: str) -> tuple[str, str]:
    """A slug and a folder of "slug=folder"."""
    slug, eq, root = (x.strip() for x in spec.partition("="))
    if not (eq and slug and root):
        raise VaultError(f"{spec!r} isn't slug=folder")
    return slug, root


def checked_sources(sources: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The sources by slug; an error for an invalid slug or one that comes twice."""
    for slug, _ in sources:
        if not SLUG.fullmatch(slug):
            raise VaultError(f"{slug!r} is no slug")
    if len({s for s, _ in sources}) < len(sources):
        raise VaultError("a slug comes twice")
    return sorted(sources)


def owned_state(entries: DataFrame) -> DataFrame:
    """(target, last_sha) from manifest entries (file_name, status, target, rendered_sha256): the newest applied one wins."""
    return entries.where("status = 'applied'").groupBy("target").agg(F.max_by("rendered_sha256", "file_name").alias("last_sha"))


def with_actions(entries: DataFrame, current: DataFrame, owned: DataFrame) -> DataFrame:
    """Entries with action and conflict_reason, from the targets' current hashes (target, sha256) and those last applied."""
    rows = entries.drop("action", "conflict_reason").join(current.select("target", F.col("sha256").alias("_now")), "target", "left").join(owned, "target", "left")
    now, last, new = F.col("_now"), F.col("last_sha"), F.col("rendered_sha256")
    own_file = F.col("source") == F.col("target")  # the global index: only a block of it is managed
    action = F.when(now.isNull(), "create").when(now == new, "unchanged").when(own_file, "update").when(last.isNull() | (now != last), "conflict").otherwise("update")
    reason = F.when(now.isNull() | (now == new) | own_file, "").when(last.isNull(), "unmanaged").when(now != last, "locally-modified").otherwise("")
    return rows.withColumns({"action": action, "conflict_reason": reason}).drop("_now", "last_sha")


def action_counts(entries: DataFrame) -> DataFrame:
    """Entries by action; actions without any have 0."""
    all_actions = entries.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    n = entries.groupBy("action").agg(F.count("*").alias("entries"))
    return F.broadcast(all_actions).join(n, "action", "left").select("action", F.coalesce("entries", F.lit(0)).alias("entries"))


def rendered_notes(files: DataFrame) -> DataFrame:
    """Notes (slug, relative, raw) with their project's tag and a link to its hub: adds target link and rendered."""
    hub = F.concat(F.lit("projects/"), F.col("slug"), F.lit("/index"))
    tagged = with_tags(F.col("raw"), F.array(F.concat(F.lit("project:"), F.col("slug"))))
    return files.withColumn("rendered", backlink_block(tagged, hub)).withColumn("link", note_link(F.col("slug"), F.col("relative")))


def note_link(slug: Column, relative: Column) -> Column:
    return F.concat(F.lit("projects/"), slug, F.lit("/"), F.regexp_replace(relative, r"\.md$", ""))


def bullets(link: str = "link") -> Column:
    """One line for each distinct link, sorted."""
    return F.array_join(F.transform(F.sort_array(F.collect_set(link)), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")


def hubs(notes: DataFrame, bases: DataFrame) -> DataFrame:
    """A hub for each project: its own index (slug, raw), or a template, with the project's tag and the list of its notes (slug, link).

    Each is a text of one row; hub_parts() has them in parts.
    """
    listed = notes.groupBy("slug").agg(bullets().alias("list"))
    known = hub_bases(bases.join(listed.select("slug"), "slug", "full_outer"))
    return known.join(listed, "slug", "left").select("slug", managed_block(F.col("raw"), "notes", F.coalesce("list", F.lit(""))).alias("rendered"))


def global_index(hub_links: DataFrame, base: str | None) -> DataFrame:
    """The global index with the list of hubs (link) in its managed block."""
    listed = hub_links.agg(bullets().alias("list"))
    return listed.select(managed_block(F.lit(base if base is not None else GLOBAL_INDEX), "projects", F.col("list")).alias("rendered"))


def in_parts(bases: DataFrame, links: DataFrame, name: str, lines: int = PART_LINES) -> DataFrame:
    """(slug, part, text): texts (slug, raw) with a list of links (slug, link) in a managed block, in parts of at most so many lines.

    The parts in order, one behind another, are the whole text: what stands before the list is part 0, what stands behind it the last one. However
    long a list is, no row and no task holds it.
    """
    listed = placed(links, "slug", "link")
    part = F.floor(F.col("place") / lines)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "link"))), lambda x: F.concat(F.lit("- [["), x["link"], F.lit("]]"))), "\n")
    body = listed.groupBy("slug", part.alias("at")).agg(text.alias("text"))  # at most so many lines a row
    body = body.select("slug", (F.col("at") + 1).alias("part"), F.concat(F.when(F.col("at") > 0, "\n").otherwise(""), F.col("text")).alias("text"))
    count = body.groupBy("slug").agg(F.max("part").alias("parts"))
    framed = bases.join(count, "slug", "left").withColumn("frame", managed_block(F.col("raw"), name, F.when(F.col("parts").isNull(), "").otherwise(SPOT)))
    ends = framed.select("slug", F.coalesce("parts", F.lit(0)).alias("parts"), F.split("frame", SPOT).alias("ends"))
    head = ends.select("slug", F.lit(0).cast("long").alias("part"), F.get("ends", F.lit(0)).alias("text"))
    tail = ends.select("slug", (F.col("parts") + 1).alias("part"), F.coalesce(F.get("ends", F.lit(1)), F.lit("")).alias("text"))
    return head.unionByName(body).unionByName(tail.where("text <> ''"))


def hub_bases(bases: DataFrame) -> DataFrame:
    """(slug, raw): each project's own index, or a template, with the project's tag."""
    base = F.coalesce("raw", F.concat(F.lit("# "), F.col("slug"), F.lit(" Project Index\n")))
    return bases.select("slug", with_tags(base, F.array(F.concat(F.lit("project:"), F.col("slug")))).alias("raw"))


def hub_parts(notes: DataFrame, bases: DataFrame, lines: int = PART_LINES) -> DataFrame:
    """hubs() in parts, for projects of any size: slug, part, text."""
    return in_parts(hub_bases(bases), notes, "notes", lines)


def skipped(all_files: DataFrame, included: DataFrame) -> DataFrame:
    """Files of a source that the scan leaves out."""
    return all_files.select("path").join(included.select("path"), "path", "left_anti")


def audit(documents: DataFrame, edges: DataFrame, physical: DataFrame, root: str) -> DataFrame:
    """Totals of a vault: files, indexed documents, edges, orphans, unresolved targets, documents from elsewhere; a row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    inside = under(F.col("path"), root)
    parts = [
        n(physical, "markdown_files"),
        documents.agg(F.count("*").alias("indexed_documents"), F.count_if(~inside).alias("external_documents")),
        n(graph.graph_edges(edges), "resolved_edges"),
        n(graph.orphans(documents.where(inside), edges), "orphans"),
        n(graph.unresolved(edges), "unresolved_targets"),
    ]
    out = parts[0]
    for p in parts[1:]:  # rows of one each
        out = out.join(F.broadcast(p))
    return out


def warnings(audit: DataFrame, missing: DataFrame) -> DataFrame:
    """What isn't in order, a row for each kind whose number is above 0."""
    row = audit.join(F.broadcast(missing))
    gap = F.col("markdown_files") - (F.col("indexed_documents") - F.col("external_documents"))
    kinds = [("external", F.col("external_documents")), ("not_indexed", gap), ("missing_on_disk", F.col("missing")), ("orphans", F.col("orphans")), ("unresolved", F.col("unresolved_targets"))]
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("number")) for k, v in kinds]))
    return row.select(stacked.alias("w")).select("w.kind", "w.number").where("number > 0")
