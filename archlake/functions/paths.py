"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column | str) -> Column:
    """Backslashes become ``/``, runs of ``/`` one, one leading ``./`` is dropped; null stays null."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), "/{2,}", "/"), r"^\./", "")


def repository(root: Column | str) -> Column:
    """A repository root without its final ``/``."""
    c = F.col(root) if isinstance(root, str) else root
    return F.regexp_replace(c, "/+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case last suffix without its dot; the empty string without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
