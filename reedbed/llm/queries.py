"""One query for each operator of this subpackage, over its whole table, and DuckDB SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_digests
from .chat import format_conversations
from .decontam import contaminated
from .hard_negatives import hard_negatives
from .mixing import mix_report
from .ngram_join import ngram_components
from .prefix_trie import prefix_trie
from .quality import quality_report
from .rans import token_file_digests
from .secrets import ACCESS, ASSIGN, HEX, OPAQUE, secret_report
from .suffix_dedup import remove_repeats
from .token_counts import edited_counts, made_edits
from .url_filter import judge_urls

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(made_edits(_table(spark, sf_dir, "documents")), BYTE_BPE)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), min_len=400)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(_table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_quality_rules, op4_decontamination, op5_edited_token_counts, op6_suffix_dedup, op7_url_filter, op8_tool_calls, op9_token_files, op10_byte_bpe, op11_source_mix, op12_hard_negatives, op13_prefix_trie)}


OP7_SQL = """WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule,
  list_has_any(string_split(host, '.'), ['ads-track', 'casino-win', 'cheap-pills']) AS listed FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r"""

OP3_SQL = """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, p, p + 4), ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
c AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM g, range(5) t(j) WHERE g.n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
h AS (SELECT source, k FROM l GROUP BY source, k HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) > 100),
x AS (SELECT l.doc_id, sum(l.words) AS n FROM l JOIN h ON h.source IS NOT DISTINCT FROM l.source AND h.k = l.k GROUP BY 1),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10 AND 100 * (n_words - n_removed_words) >= 20 * n_words AS kept FROM a"""


def _places_sql(kind: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, lang, {kind} AS kind, p + g - n AS s, p + g AS e, v FROM (SELECT doc_id, source, lang, v, n, sum(n) OVER o AS p, sum(length(gap)) OVER o AS g FROM
    (SELECT doc_id, source, lang, unnest(h) AS hit, unnest(vs) AS v, unnest(list_slice(gaps, 1, len(h))) AS gap, unnest(range(len(h))) AS i, length(unnest(h)) AS n FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{quoted}', 0) AS h, regexp_extract_all(text, '{quoted}', {group}) AS vs, string_split_regex(text, '{quoted}') AS gaps FROM d)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE length(v) >= {least}"""


OP2_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
b AS ({_places_sql(0, ASSIGN, 2, 12)} UNION ALL {_places_sql(1, ACCESS, 0, 18)} UNION ALL {_places_sql(2, HEX, 0, 16)}),
x AS (SELECT * FROM ({_places_sql(3, OPAQUE, 0, 24)}) o WHERE len(regexp_extract_all(v, '[0-9]')) >= 4 AND len(regexp_extract_all(v, '[A-Za-z]')) >= 4 AND len(list_distinct(string_split(v, ''))) >= 10 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = o.doc_id AND b.s < o.e AND o.s < b.e)),
a AS (SELECT *, v IN (SELECT v FROM (SELECT v, source, lang FROM b UNION ALL SELECT v, source, lang FROM x) GROUP BY v HAVING count(DISTINCT source) <= 2 AND count(DISTINCT (source, lang)) <= 3) AS live FROM (SELECT * FROM b UNION ALL SELECT * FROM x)),
t AS (SELECT doc_id, kind, live, s, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS j FROM a)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(j, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(j, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id"""


OP12_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER o AS INT) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score WINDOW o AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER o <= 3"""

# The CRC-32 goes bit by bit over the digits of the id.
OP13_SQL = """WITH t AS (SELECT conv_id, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS s FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d AS depth, len(s) = d AS ends, array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.k), '') AS path, array_to_string(list_transform(list_slice(s, 1, d - 1), lambda x: x.k), '') AS up, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w FROM s, generate_series(0, len(s)) g(d)),
n AS (SELECT path, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth),
r AS (SELECT left(path, 32 * CAST(d AS INT)) AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM a, generate_series(0, a.depth) g(d) GROUP BY ALL)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, r.n_leaves, CAST(r.saved AS BIGINT) AS saved_tokens, a.ends_sha256 FROM a JOIN r ON r.path = a.path AND r.depth = a.depth LEFT JOIN a u ON a.depth > 0 AND u.path = a.up AND u.depth = a.depth - 1"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": OP2_SQL, "op3_quality_rules": OP3_SQL, "op7_url_filter": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
