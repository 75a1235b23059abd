"""Vectors from an embedding server over HTTP, in either of two dialects; and one without a server for tests and offline use."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from array import array
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol
from urllib.parse import urlparse, urlunparse

from lorescape.errors import EmbeddingBackendError

BATCH, TIMEOUT = 32, 60.0


class Dialect(NamedTuple):
    """How a kind of server is asked: the route, a part of it that endpoints may end with, and the field of the reply with the vectors."""

    route: str
    given: str
    field: str
    one: str | None  # the field of one vector in a list of objects


# fixed values
DIALECTS = {"openai": Dialect("/v1/embeddings", "/v1", "data", "embedding"), "ollama": Dialect("/api/embed", "", "embeddings", None)}
LAST_PARTS = ("embeddings", "embed")
LOCAL = ("localhost", "127.0.0.1", "::1")


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@dataclass(frozen=True)
class Settings:
    model: str
    endpoint: str | None = None
    api: str | None = None
    dimension: int | None = None
    key: str | None = None
    allow_remote: bool = False

    @property
    def is_remote(self) -> bool:
        return self.endpoint is not None and (urlparse(self.endpoint).hostname or "") not in LOCAL

    @property
    def is_blocked(self) -> bool:
        """Texts leave the machine only if that was asked for."""
        return self.is_remote and not self.allow_remote

    @property
    def dialect(self) -> str:
        return self.api.strip().lower() if self.api is not None else "openai" if "/v1" in urlparse(self.endpoint or "").path else "ollama"

    @property
    def url(self) -> str:
        parts = urlparse(self.endpoint or "")
        if parts.scheme not in ("http", "https"):
            raise EmbeddingBackendError(f"{parts.scheme!r} isn't http" if self.endpoint else "no endpoint")
        path = parts.path.rstrip("/")
        if not path.endswith(LAST_PARTS):  # else the endpoint is a route already
            dialect = DIALECTS.get(self.dialect, DIALECTS["ollama"])
            path = path.removesuffix(dialect.given) + dialect.route
        return urlunparse(parts._replace(path=path))


def shown(endpoint: str) -> str:
    """An endpoint without what may be secret."""
    p = urlparse(endpoint)
    host = (p.hostname or "") + (f":{p.port}" if p.port is not None else "")
    return urlunparse((p.scheme, host, p.path, "", "", ""))


def described(settings: Settings | None) -> str:
    """The state of the vector side in a line."""
    if settings is None:
        return "not configured, BM25 only"
    if settings.is_blocked:
        return f"{settings.model}: remote endpoint {shown(settings.endpoint or '')} is blocked"
    if settings.endpoint is None:
        return f"{settings.model}: no endpoint configured"
    return f"{settings.model} via {shown(settings.endpoint)} ({settings.dialect})" + (f", dimension {settings.dimension}" if settings.dimension else "")


def vectors_of(reply: object) -> list[list[float]]:
    """The vectors of a reply in the order of the texts, whichever dialect it is in."""
    try:
        dialect = next(d for d in reversed(DIALECTS.values()) if isinstance(reply.get(d.field), list))
        rows = reply[dialect.field]
        if dialect.one:
            rows = [x[dialect.one] for x in sorted(rows, key=lambda x: x["index"] if type(x.get("index")) is int else 0)]
        if not all(isinstance(v, list) for v in rows):
            raise TypeError
        return [list(array("d", v)) for v in rows]  # takes numbers only
    except (StopIteration, TypeError, KeyError, AttributeError) as e:
        raise EmbeddingBackendError("malformed reply") from e


class HttpProvider:
    """Asks a server for BATCH texts at a time. It can be sent to the executors."""

    def __init__(self, settings: Settings, batch: int = BATCH, timeout: float = TIMEOUT):
        if settings.is_blocked:
            raise EmbeddingBackendError(f"remote endpoint {shown(settings.endpoint or '')} is blocked")
        self.settings, self.batch, self.timeout = settings, batch, timeout

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            found = self._asked(part)
            wrong = self.settings.dimension is not None and any(len(v) != self.settings.dimension for v in found)
            if len(found) != len(part) or wrong:
                raise EmbeddingBackendError("wrong number or width of vectors")
            out += found
        return out

    def _asked(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.settings.key}"} if self.settings.key else {})
        body = json.dumps({"model": self.settings.model, "input": texts}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.settings.url, body, headers), timeout=self.timeout) as reply:  # noqa: S310
                return vectors_of(json.load(reply))
        except (OSError, ValueError) as e:
            raise EmbeddingBackendError(f"{shown(self.settings.url)}: {e}") from e


class HashProvider:
    """Bags of words hashed to a width: no server, the same vector for the same text everywhere."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                v[int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % self.width] += 1.0
            out.append(v)
        return out


def loaded(settings: Settings | None) -> HttpProvider | None:
    """A provider, or None where search has to do without: nothing configured, blocked, or an endpoint that can't be used."""
    try:
        if settings is None or settings.is_blocked or not settings.url:
            return None
        return HttpProvider(settings)
    except EmbeddingBackendError:
        return None
