"""What can go wrong, by kind, so that callers can tell the kinds apart."""

from __future__ import annotations


class LoreError(Exception):
    """Any error of this library."""


class DocumentReadError(LoreError):
    """A Markdown file is missing, is no file, or can't be read as UTF-8."""


class DocumentNotFoundError(LoreError):
    """No document has the id that was asked for."""


class ConfigReadError(LoreError):
    """A configuration file can't be read, or a setting in it has the wrong type or form."""


class ProjectScopeError(LoreError):
    """A project scope isn't a valid slug."""


class VaultError(LoreError):
    """A vault plan has invalid sources, or conflicts keep it from being applied."""


class EmbeddingBackendError(LoreError):
    """An embedding server can't be reached or gives a malformed reply."""


class ColumnTypeError(LoreError):
    """A table lacks a column, or a column has another type than the engine needs."""


class WarehouseError(LoreError):
    """A warehouse has tables without a manifest, or was changed by another writer in the meantime."""


class Clash(WarehouseError):
    """A change can't stand on what another writer has done in the meantime; it has to be made anew."""
