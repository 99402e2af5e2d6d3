"""Registered queries, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import ctes

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

KEY = "CASE WHEN length(doi) > 0 THEN 'doi:' || lower(regexp_replace(doi, '^\\s+|\\s+$', '', 'g')) ELSE 'title:' || lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')) END"
# Canonical papers, copies and editions in SQL, over fx_entries.
MORE = {
    "m_map": f"SELECT *, id AS entry_id, min(id) OVER (PARTITION BY paper_key) AS paper_id FROM (SELECT *, {KEY} AS paper_key FROM fx_entries)",
    "m_papers": "SELECT * FROM m_map WHERE id = paper_id",
    "m_editions": "SELECT paper_id, sha256, min(id) AS id FROM m_map GROUP BY paper_id, sha256",
    "m_latest": "SELECT paper_id, max(id) AS latest FROM m_editions GROUP BY paper_id",
    "m_copies": """SELECT c.*, CASE WHEN c.id % 3 = 0 THEN e.id END AS edition_id, CASE WHEN c.id % 5 = 0 THEN l.latest END AS ignored_edition_id
      FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, user_id ORDER BY id) AS rn FROM m_map WHERE user_id IS NOT NULL) c
      JOIN m_editions e ON e.paper_id = c.paper_id AND e.sha256 = c.sha256 JOIN m_latest l ON l.paper_id = c.paper_id WHERE rn = 1""",
}


def with_sql(*names: str, body: str) -> str:
    """body with the projections it needs before it; m_ names add the canonical tables."""
    fx = [n for n in names if n.startswith("fx_")]
    own = [f"{k} AS ({v})" for k, v in MORE.items()] if "m" in names else []
    if "m" in names and "fx_entries" not in fx:
        fx.append("fx_entries")
    if not fx:
        return body
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        own, body = [*own, body.removeprefix("WITH ").removeprefix("RECURSIVE ")], ""
    out = ctes(*fx, more=", ".join(own)) + body
    return out.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else out


def query(*names: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of (spark, sf_dir) under its name; names are the projections that sql needs."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_sql(*names, body=sql)
        return f

    return add
