"""Settings: TOML files beside a project and in the home folder, and environment variables, from the most to the least special."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from lorescape.errors import ConfigReadError
from lorescape.operators.scope import PREFIX, project_tag
from lorescape.sources.embedding import Settings

FOLDER, FILE = ".lorescape", "config.toml"
ENV = "LORESCAPE_"


def read(path: Path) -> dict[str, object]:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigReadError(f"{path}: {e}") from e


def nearest(start: Path) -> Path | None:
    """The configuration of the project that a folder is in."""
    start = start.resolve()
    return next((f for d in (start, *start.parents) if (f := d / FOLDER / FILE).is_file()), None)


def text(values: dict[str, object], name: str) -> str | None:
    v = values.get(name)
    if v is not None and not isinstance(v, str):
        raise ConfigReadError(f"{name} should be a string")
    return v


def home(given: Path | None = None) -> Path:
    return (given or Path(os.environ.get(ENV + "HOME") or Path.home() / FOLDER)).expanduser()


def warehouse(given: str | None = None, start: Path | None = None) -> str:
    """Where the tables are: given, else the environment's, an isolated project's own, the home file's, or the home folder's.

    Only a project in isolated mode has a warehouse of its own, and has to name it.
    """
    if place := given or os.environ.get(ENV + "WAREHOUSE"):
        return place
    found = nearest(start or Path.cwd())
    values = read(found) if found else {}
    if values.get("mode") == "isolated":
        own = text(values, "warehouse")
        if not own:
            raise ConfigReadError(f"{found}: an isolated project has to name its warehouse")
        return str((found.parent / Path(own).expanduser()).resolve())
    file = home() / FILE
    own = text(read(file), "warehouse") if file.is_file() else None
    return str((file.parent / Path(own).expanduser()).resolve()) if own else str(home() / "warehouse")


def project(start: Path | None = None) -> str | None:
    """The tag of the project that a folder is in."""
    found = nearest(start or Path.cwd())
    name = text(read(found), "project") if found else None
    return project_tag(name) if name else None


def embedding(start: Path | None = None) -> Settings | None:
    """Each field from the environment, else the project's file, else the home's; None without a model."""
    files = [f for f in (nearest(start or Path.cwd()), home() / FILE) if f and f.is_file()]
    parts = [v if isinstance(v := read(f).get("embedding"), dict) else {} for f in files]

    def first(name: str, kind: type) -> object:
        candidates = [os.environ.get(f"{ENV}EMBED_{name.upper()}") or None, *(p.get(name) for p in parts)]
        for c in candidates:
            if kind is bool and isinstance(c, str):
                c = c.strip().lower() in ("1", "true", "yes", "on")
            if kind is int and isinstance(c, str):
                c = int(c) if c.strip().isdigit() else None
            if isinstance(c, kind) and (kind is not int or not isinstance(c, bool)) and c != "":
                return c
        return None

    model = first("model", str)
    if model is None:
        return None
    return Settings(model, first("endpoint", str), first("api", str), first("dimension", int), first("key", str), bool(first("allow_remote", bool)))


__all__ = ["PREFIX", "embedding", "home", "nearest", "project", "read", "warehouse"]
