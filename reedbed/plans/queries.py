"""All queries of the library."""

from __future__ import annotations

from . import queries_library, queries_references, queries_seminars  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
