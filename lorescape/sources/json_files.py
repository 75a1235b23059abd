"""JSON written by earlier runs: vault manifests, and the state files of sessions. Files that can't be read are skipped."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.functions.text import coerced_count
from lorescape.schemas import DDL

MANIFEST = "version int, status string, entries array<struct<source:string,target:string,source_sha256:string,rendered_sha256:string,action:string,conflict_reason:string>>, _corrupt_record string"
STATE = "last_context_hash string, updated_at double, cached_db_mtime double, context_len string, session_id string, cwd string, dedup_hits string, saved_chars string, _corrupt_record string"


def manifest_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, status, target, rendered_sha256) of all manifests in a folder."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    rows = rows.withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1)).where("_corrupt_record is null")
    return rows.select("file_name", "status", F.explode("entries").alias("e")).select("file_name", "status", "e.target", "e.rendered_sha256").where("target is not null and rendered_sha256 is not null")


def write_manifest(folder: Path, entries: DataFrame, status: str, name: str | None = None, staging: str | None = None) -> str:
    """Writes a plan's entries, without their texts, as the next manifest (or over the one it planned); returns its name.

    Entries pass the driver one at a time. The file is written aside and renamed, so that it is there whole or not at all.
    """
    folder.mkdir(parents=True, exist_ok=True)
    if name is None:
        known = [int(f.stem) for f in folder.glob("*.json") if f.stem.isdigit()]
        name = f"{max(known, default=0) + 1:06d}.json"
    aside = folder / f".{name}.aside"
    with aside.open("w", encoding="utf-8") as out:
        out.write(json.dumps({"version": 1, "status": status, "staging": staging}, ensure_ascii=False)[:-1] + ', "entries": [')
        for i, r in enumerate(entries.drop("rendered").orderBy("target").toLocalIterator()):
            out.write((",\n " if i else "\n ") + json.dumps(r.asDict(), ensure_ascii=False))
        out.write("\n]}\n")
    aside.replace(folder / name)
    return name


def marked_applied(path: Path) -> None:
    """Turns a planned manifest into an applied one; only its first line changes."""
    aside = path.with_name(f".{path.name}.aside")
    with path.open(encoding="utf-8") as old, aside.open("w", encoding="utf-8") as out:
        out.write(next(old).replace('"status": "planned"', '"status": "applied"', 1))
        out.writelines(old)
    aside.replace(path)


def session_states(spark: SparkSession, glob: str) -> DataFrame:
    """State files as rows; counts that aren't whole numbers are 0."""
    rows = spark.read.schema(STATE).option("multiLine", True).option("mode", "PERMISSIVE").json(glob).where("_corrupt_record is null")
    counts = {c: coerced_count(F.col(c)) for c in ("context_len", "dedup_hits", "saved_chars")}
    return rows.withColumns(counts).select(*[f.split()[0] for f in DDL["session_state"].split(", ")])
