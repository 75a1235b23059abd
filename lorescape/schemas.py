"""Schemas of the engine's tables. They are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lorescape.errors import ColumnTypeError

DDL = {
    "documents": "doc_id long, path string, title string, tags array<string>, body string",
    "links": "source_id long, ordinal int, target string",
    "chunks": "doc_id long, ordinal int, heading string, text string, content_hash string",
    "postings": "gram string, doc_id long",
    "paths": "name string, doc_id long, path string, digest string, length long",
    "targets": "n string, w string, dst_id long",
    "lengths": "documents long, mean_length double",
    "embeddings": "content_hash string, model string, dimension int, vector array<float>",
    "usage": "doc_id long, retrieved_count long, last_retrieved_at timestamp",
    "retrievals": "doc_id long, retrieved_at timestamp",
    "failures": "path string, reason string",
    "vault_entries": "source string, target string, source_sha256 string, rendered_sha256 string, action string, rendered string, conflict_reason string",
    "snapshot": "path string, mtime double",
    "session_state": "session_id string, cwd string, last_context_hash string, updated_at double, cached_db_mtime double, context_len long, dedup_hits long, saved_chars long",
}


#: What segments of the warehouse hold, where it isn't the table's own columns.
SEGMENTS = {
    "links": "source_id long, ordinal int, target string, w string, n string",
    "postings": "gram string, block long, n int, ids array<smallint>",
    "gone": "doc_id long, final boolean, at long",
    "moved": "w string, final boolean, at long",
    "pruned": "content_hash string, final boolean, at long",
}
DDL |= {f"{name}_segment": SEGMENTS.get(name, DDL.get(name)) for name in ("documents", "paths", "links", "targets", "chunks", "postings", "embeddings", "usage", "gone", "moved", "pruned")}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def checked(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order, or an error that names the first one that is missing or of another type."""
    types = dict(df.dtypes)
    for field in schema(name):
        if types.get(field.name) != field.dataType.simpleString():
            raise ColumnTypeError(f"{name}.{field.name} should be {field.dataType.simpleString()}, not {types.get(field.name)}")
    return df.select(*schema(name).fieldNames())
