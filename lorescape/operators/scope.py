"""Which documents a search may return: by project and by tags, and which of them come last."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorescape.errors import ProjectScopeError

PREFIX = "project:"
SLUG = re.compile(r"[a-z0-9][a-z0-9._-]*")
DRAFT = "draft"


def project_tag(scope: str) -> str:
    """The tag of a project that is given by its slug or its tag."""
    slug = scope.strip().removeprefix(PREFIX)
    if not SLUG.fullmatch(slug):
        raise ProjectScopeError(f"{scope!r} is no project")
    return PREFIX + slug


def in_project(tag: str, tags: Column | str = "tags") -> Column:
    """Documents of the project, and those of none."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return ~F.exists(tags, lambda t: F.startswith(t, F.lit(PREFIX))) | F.array_contains(tags, tag)


def wanted_tags(tags: Sequence[str]) -> list[str]:
    return sorted({t.strip() for t in tags} - {""})


def has_all(tags: Sequence[str], column: str = "tags") -> Column:
    """Documents with every one of these tags; blank ones don't count, and none asks for nothing."""
    wanted = wanted_tags(tags)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(column))) == 0 if wanted else F.lit(True)


def is_draft(column: str = "tags") -> Column:
    return F.array_contains(F.col(column), DRAFT)
