"""Projections of the star-schema tables into the library's tables, as SQL that Spark and DuckDB both run.

Texts are taken whole; a work's title is its text's first sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("customer", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "embeddings")

FX: dict[str, str] = {
    "fx_line": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity,
  min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_users": """SELECT c_custkey AS id, lower(c_name) || '@example.org' AS email, c_name AS display_name,
  CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS affiliation,
  c_nationkey % 3 <> 0 AS email_public, c_custkey % 40 = 0 AS is_admin, c_custkey % 29 = 7 AS is_deleted
FROM customer""",
    "fx_entries": """SELECT l.l_orderkey * 8 + l.l_linenumber AS id, o.o_custkey AS user_id,
  CASE WHEN l.l_partkey % 4 = 0 THEN NULL WHEN l.l_linenumber % 2 = 0 THEN ' 10.5555/PART.' || CAST(l.l_partkey AS STRING)
       ELSE '10.5555/part.' || CAST(l.l_partkey AS STRING) END AS doi,
  CASE WHEN l.l_linenumber % 2 = 0 THEN upper(p.p_name) ELSE p.p_name || ' ' END AS title,
  '["' || p.p_brand || '","' || p.p_type || '"]' AS authors, p.p_type AS journal, 1950 + p.p_size AS year,
  's' || CAST(l.l_suppkey AS STRING) AS sha256, 'file-' || CAST(l.l_suppkey AS STRING) || '.pdf' AS file_path,
  l.l_returnflag <> 'R' AS marketed, l.l_linestatus = 'F' AND l.l_linenumber = 1 AS is_author,
  CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE 1 + CAST(l.l_quantity AS INT) % 5 END AS rating_liking,
  CAST(1 + l.l_suppkey % 5 AS INT) AS rating_expertise, CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE CAST(1 + l.l_partkey % 5 AS INT) END AS rating_reading,
  CASE WHEN l.l_linenumber % 3 = 1 THEN 'thought ' || CAST(l.l_orderkey AS STRING) END AS thought, 'summary ' || CAST(l.l_orderkey AS STRING) AS summary,
  o.o_orderdate AS created_at
FROM fx_line l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "fx_rooms": """SELECT o_orderkey AS id, CASE WHEN (o_orderkey % 200) % 4 = 0 THEN 'title:none' ELSE 'doi:10.5555/part.' || CAST(o_orderkey % 200 AS STRING) END AS paper_key,
  o_custkey AS created_by, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_custkey END AS leader_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'open' WHEN o_orderpriority LIKE '2%' THEN 'planning' WHEN o_orderpriority LIKE '3%' THEN 'scheduled' ELSE 'finished' END AS status,
  o_orderdate AS created_at FROM orders""",
    "fx_participants": "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS room_id, l_suppkey AS user_id, l_shipdate AS created_at FROM fx_line",
    "fx_room_events": """SELECT event_id AS seq, user_id AS room_id, CAST(floor(value) AS INT) % 3 AS actor_id,
  CASE event_type WHEN 'signup' THEN 'call' WHEN 'click' THEN 'lead' WHEN 'view' THEN 'announce' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'join' ELSE 'unhost' END END AS action, ts FROM events""",
    "fx_notifications": "SELECT event_id AS id, user_id, event_id % 100 AS room_id, event_type || ' ' || props AS content, value < 40 AS read, event_type = 'error' AS emailed, ts AS created_at FROM events",
    "fx_requests": "SELECT event_id AS id, user_id AS token, ts, event_type = 'error' AS revokes FROM events",
    "fx_statements": """SELECT event_id AS id, CASE event_type WHEN 'view' THEN '  select * FROM "papers" WHERE id = 1' WHEN 'click' THEN 'INSERT INTO copies VALUES (1)' WHEN 'purchase' THEN 'UPDATE OR IGNORE users SET a = 1' WHEN 'error' THEN 'PRAGMA table_info(users)' ELSE 'DELETE FROM auth_tokens' END AS statement, value AS ms, ts AS at FROM events""",
    "fx_feedback": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, 'report ' || props AS content, CASE WHEN event_id % 2 = 0 THEN '#/library' END AS page, CASE WHEN event_id % 6 = 0 THEN 'v@example.org' END AS contact, value > 200 AS resolved, ts AS created_at FROM events WHERE event_type = 'error'",
    "fx_comments": """SELECT doc_id AS id, doc_id % 20 AS paper_id, n_chars % 15 AS user_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS content,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 3 END AS edition_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + n_chars % 12 END AS page,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '{"x": ' || CAST(CAST(doc_id % 50 AS DOUBLE) / CAST(64 AS DOUBLE) AS STRING) || ', "y": 0.5}' END AS anchor, doc_id % 4 = 0 AS current_place FROM documents""",
    "fx_references": """SELECT doc_id AS id, doc_id % 50 AS edition_id, 'b' || CAST(doc_id AS STRING) AS key, text AS raw, CAST(NULL AS STRING) AS title, CAST(1990 + doc_id % 12 AS INT) AS year,
  CASE WHEN doc_id % 6 = 0 THEN 'https://doi.org/10.5555/PART.' || CAST(doc_id % 200 AS STRING) END AS doi, 1 + doc_id % 9 AS page, CAST(n_chars % 97 AS DOUBLE) / CAST(128 AS DOUBLE) AS y FROM documents""",
    "fx_works": """SELECT item_id AS id, '10.6666/w.' || CAST(item_id AS STRING) AS doi, regexp_extract(text, '^[^.\n]*', 0) AS title, CAST(1990 + item_id % 12 AS INT) AS year, 0 AS source_rank FROM benchmark
UNION ALL SELECT 1000000 + doc_id AS id, '10.6666/d.' || CAST(doc_id AS STRING) AS doi, regexp_extract(text, '^[^.\n]*', 0) AS title, CAST(1990 + doc_id % 15 AS INT) AS year, 1 AS source_rank FROM documents""",
    "fx_page_links": "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 50 AS edition_id, CAST(1 + l_partkey % 9 AS INT) AS page, l_quantity / CAST(64 AS DOUBLE) AS y FROM fx_line",
}
NEEDS = {"fx_entries": ["fx_line"], "fx_participants": ["fx_line"], "fx_page_links": ["fx_line"]}


class Tables:
    """The projections of one folder of tables; each is a DataFrame made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, statement: str) -> DataFrame:
        """A statement over the source tables and projections it names."""
        for name in SOURCES:
            if name in statement:
                # Lines are dealt by order once: their grouping, orders and rooms all go by it.
                rows = self.source(name)
                (rows.repartition("l_orderkey") if name == "lineitem" else rows).createOrReplaceTempView(name)
        for name in FX:
            if name in statement and FX[name] != statement:
                self.__getattr__(name).createOrReplaceTempView(name)
        return self.spark.sql(statement)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FX:
            raise AttributeError(name)
        return self.sql(FX[name])


def ctes(*names: str, more: str = "") -> str:
    """A WITH clause that defines the projections, and those they need, for an engine that has the source tables."""
    out: dict[str, str] = {}
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            out[need] = FX[need]
    body = ", ".join(f"{k} AS ({v})" for k, v in out.items())
    return "WITH " + body + (f", {more}" if more else "") + " "
