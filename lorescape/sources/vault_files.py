"""The vault as files: planning copies of projects' notes below a home folder, and writing them.

Plans are tables. Texts are staged by the executors; then a manifest is written ahead, from which an import that was cut off can be
finished, the staged files are renamed one by one, and the manifest is marked as applied.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.errors import VaultError
from lorescape.functions.text import sha256
from lorescape.operators import vault
from lorescape.operators.durable import written
from lorescape.sources.json_files import manifest_entries, marked_applied, write_manifest
from lorescape.sources.markdown import decoded, files

STAGING, MANIFESTS = ".staging", "migrations"
ENTRY = "source string, target string, source_sha256 string, rendered_sha256 string, action string, rendered string, conflict_reason string"


def _notes(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(slug, path, relative, raw) of all sources."""
    parts = [files(spark, root).select(F.lit(slug).alias("slug"), "path", "relative", decoded(F.col("content")).alias("raw")) for slug, root in sources]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "slug string, path string, relative string, raw string")


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("source", "target", sha256(F.coalesce("raw", F.lit(""))).alias("source_sha256"), sha256(F.col("rendered")).alias("rendered_sha256"), F.lit("create").alias("action"), "rendered", F.lit("").alias("conflict_reason"))


def plan(spark: SparkSession, home: str, sources: list[tuple[str, str]]) -> DataFrame:
    """The entries of an import, with their actions: each project's notes and hub, and the global index."""
    sources = vault.checked_sources(sources)
    home = os.path.realpath(home)
    for _, root in sources:
        if not os.path.isdir(root):
            raise VaultError(f"{root} is no folder")
    all_notes = _notes(spark, [(s, os.path.realpath(r)) for s, r in sources])
    folder = F.concat(F.lit(f"{home}/docs/projects/"), F.col("slug"), F.lit("/"))
    notes = vault.rendered_notes(all_notes.where("relative <> 'index.md'"))
    entries = _entries(notes.select(F.col("path").alias("source"), F.concat(folder, "relative").alias("target"), "raw", "rendered"))

    there = Path(home, "docs", "projects")
    physical = files(spark, str(there)).select("relative", "path", "content") if there.is_dir() and any(there.rglob("*.md")) else None
    links = notes.select("slug", "link")
    if physical is not None:  # notes of projects that another machine has brought
        parts = physical.where("relative like '%/%'").select(F.substring_index("relative", "/", 1).alias("slug"), F.regexp_replace("relative", r"\.md$", "").alias("r"))
        links = links.unionByName(parts.where(F.col("r") != F.concat("slug", F.lit("/index"))).select("slug", F.concat(F.lit("projects/"), "r").alias("link")))
    known = spark.createDataFrame([(s, f"{os.path.realpath(r)}/index.md") for s, r in sources], "slug string, source string")
    bases = known.join(all_notes.where("relative = 'index.md'").select("slug", "raw"), "slug", "left")
    hubs = vault.hubs(links.join(known.select("slug"), "slug", "left_semi"), bases.select("slug", "raw")).join(bases, "slug")
    entries = entries.unionByName(_entries(hubs.select("source", F.concat(folder, F.lit("index.md")).alias("target"), "raw", "rendered")))

    index = Path(home, "docs", "index.md")
    base = index.read_text(encoding="utf-8") if index.is_file() else None
    hub_links = {f"projects/{s}/index" for s, _ in sources} | {f"projects/{p.parent.name}/index" for p in there.glob("*/index.md")}
    made = vault.global_index(spark.createDataFrame([(x,) for x in hub_links], "link string"), base)
    made = made.select(F.lit(str(index)).alias("source"), F.lit(str(index)).alias("target"), F.lit(base or vault.GLOBAL_INDEX).alias("raw"), "rendered")
    entries = entries.unionByName(_entries(made))

    current = spark.createDataFrame([], "target string, sha256 string")
    docs = Path(home, "docs")
    if docs.is_dir() and any(docs.rglob("*.md")):
        current = files(spark, str(docs)).select(F.col("path").alias("target"), F.sha2("content", 256).alias("sha256"))
    manifests = Path(home, MANIFESTS)
    owned = vault.owned_state(manifest_entries(spark, str(manifests))) if any(manifests.glob("*.json")) else spark.createDataFrame([], "target string, last_sha string")
    return vault.with_actions(entries, current, owned).select(*[c.split()[0] for c in ENTRY.split(", ")])


def apply(entries: DataFrame, home: str) -> str:
    """Writes what a plan without conflicts creates or updates; returns the manifest's name.

    Executors stage the texts below the home folder, which they have to reach; the planned manifest is the log from which recover()
    goes on if the process dies between any two renames.
    """
    home = os.path.realpath(home)
    recover(home)
    with written(entries) as held:  # planned once
        if n := held.where("action = 'conflict'").count():
            raise VaultError(f"{n} conflicts keep the plan from being applied")
        staging = f"{STAGING}/{uuid.uuid4().hex}"
        with written(staged(held.where(F.col("action").isin("create", "update")).select("target", "rendered"), f"{home}/{staging}")) as before:
            name = write_manifest(Path(home, MANIFESTS), held.join(before, "target", "left"), "planned", staging=staging)
    finished(home, name)
    return name


def staged(texts: DataFrame, folder: str) -> DataFrame:
    """Writes texts (target, rendered) into a folder, under a hash of the target; returns what the target holds now: target, previous_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for target, text in zip(b.column("target").to_pylist(), b.column("rendered").to_pylist(), strict=True):
                aside = f"{_staged(folder, target)}.{uuid.uuid4().hex}"  # a task may run twice
                Path(aside).write_text(text, encoding="utf-8", newline="")
                os.replace(aside, _staged(folder, target))
            yield pa.RecordBatch.from_arrays([b.column("target"), pa.array([_sha(t) for t in b.column("target").to_pylist()], pa.string())], names=["target", "previous_sha256"])

    return texts.mapInArrow(run, "target string, previous_sha256 string")


def _staged(folder: str, target: str) -> str:
    return f"{folder}/{hashlib.sha256(target.encode()).hexdigest()}"


def _sha(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except FileNotFoundError:
        return None


def finished(home: str, name: str) -> None:
    """Renames what a planned manifest has staged, as far as that hasn't been done, and marks the manifest as applied.

    A target that somebody has changed since the plan is left alone, and so is the manifest: an error names it.
    """
    path = Path(home, MANIFESTS, name)
    log = json.loads(path.read_text(encoding="utf-8"))
    folder, edited = f"{home}/{log['staging']}", []
    for e in log["entries"]:
        text = _staged(folder, e["target"])
        if not os.path.exists(text):
            continue  # unchanged, or renamed before
        if _sha(e["target"]) not in (e.get("previous_sha256"), e["rendered_sha256"]):
            edited.append(e["target"])
            continue
        Path(e["target"]).parent.mkdir(parents=True, exist_ok=True)
        _rename(text, e["target"])
    if edited:
        raise VaultError(f"changed since the plan: {', '.join(edited)}")
    marked_applied(path)
    shutil.rmtree(folder, ignore_errors=True)
    if not any(Path(home, STAGING).glob("*")):
        shutil.rmtree(Path(home, STAGING), ignore_errors=True)


def _rename(staged: str, target: str) -> None:
    os.replace(staged, target)


def recover(home: str) -> list[str]:
    """Finishes imports that were cut off: rolls planned manifests with staged texts forward, drops texts without one; the manifests' names."""
    home, done, known = os.path.realpath(home), [], set()
    for path in sorted(Path(home, MANIFESTS).glob("*.json")):
        with path.open(encoding="utf-8") as f:
            first = f.readline().rstrip().removesuffix('"entries": [').rstrip().removesuffix(",")
        try:
            head = json.loads(first + "}")
        except ValueError:
            continue  # not one of ours
        if head.get("status") == "planned" and head.get("staging") and Path(home, head["staging"]).is_dir():
            known.add(Path(home, head["staging"]))
            finished(home, path.name)
            done.append(path.name)
    for folder in Path(home, STAGING).glob("*"):
        if folder not in known:
            shutil.rmtree(folder, ignore_errors=True)
    if Path(home, STAGING).is_dir() and not any(Path(home, STAGING).iterdir()):
        Path(home, STAGING).rmdir()
    return done
