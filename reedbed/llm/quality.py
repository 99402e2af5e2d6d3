"""Quality rules: per-document rules, and cross-document line frequency. Spark SQL expressions only.

Normalised lines are hashed and counted over the distinct documents of each host. A line that more than max_docs documents
of its host hold is removed; a document that is depleted by this is rejected. keep_first leaves such a line in the host's
first document that has it, so that a page in very many copies keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

GAP = r"[\x20\x09-\x0D]+"
MAX_DOCS = 100  # documents of one host that may share a line
MIN_WORDS = 10
SALTS = 16  # parts that the documents with a frequent line are dealt into when they meet it
MIN_LEFT = 20  # per cent of a document's words that must be left


def bind(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words inside n-word windows that occur twice or more in the list, the first occurrence included."""

    def covered(pairs: Column) -> Column:
        twin = F.filter(pairs, lambda p, i: (F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False))) | (F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))))
        places = F.sort_array(F.transform(twin, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def windows(hashes: Column) -> Column:
        full = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, n))))
        return F.slice(full, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))

    def count(own: Column) -> Column:
        pairs = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(bind(pairs, covered))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: bind(windows(hashes), count))


def line_key(line: Column) -> Column:
    """Hash of the normalised line: lower case, white space as single spaces, none at its ends."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, GAP, " "))))


def document_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, text) -> doc_id, host, th, the base columns, and lines (h, words)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("th"),
        bind(word_list(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.transform(x, lambda y: F.struct(line_key(y).alias("h"), F.size(word_list(y)).alias("words"))).alias("lines"))).alias("l"),
    )
    out = out.select("doc_id", "host", "th", "w.*", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "l.lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def frequent_lines(rules: DataFrame, max_docs: int) -> DataFrame:
    """(host, h, first_doc): lines in more than max_docs documents of a host; null is a host too.

    Documents are distinct ids, null one of them. Ids that are repeated in a host have their lines made distinct before they
    are counted; all others are counted before they are shuffled.
    """
    again = rules.groupBy("doc_id", "host").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("host").eqNullSafe(F.col("__host"))
    held = lambda rows: rows.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    each = held(rules.join(again, same, "left_anti")).union(held(rules.join(again, same, "left_semi")).distinct())
    return each.groupBy("host", "h").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter(F.col("docs") > max_docs).select("host", "h", "first_doc")


def _met(lines: DataFrame, heavy: DataFrame, keep_first: bool, how: str, host: str, h: str, doc: str, key: str) -> DataFrame:
    """lines joined with the frequent ones, whose many rows are dealt into parts."""
    parts = heavy.select(F.col("host").alias("__host"), F.col("h").alias("__key"), F.col("first_doc").alias("__first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__part"))
    on = (F.col(h) == F.col("__key")) & (F.pmod(F.xxhash64(doc, key), F.lit(SALTS)) == F.col("__part")) & F.col(host).eqNullSafe(F.col("__host"))
    return lines.join(parts, on & ~F.col(doc).eqNullSafe(F.col("__first")) if keep_first else on, how)


def quality_verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(verdicts, frequent lines). verdicts: doc_id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_words, kept; one row per row of docs.

    Null text is empty and fails; rows that repeat an id and a text have one outcome; null ids and hosts are values like
    others. Other columns are ignored. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "quality")
    rules = document_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")))
    rules = space.keep(rules, "rules")
    heavy = space.keep(frequent_lines(rules, max_docs), "lines")
    held = rules.dropDuplicates(["doc_id", "th", "host"]).select("doc_id", "th", "host", F.explode("lines").alias("x")).select("doc_id", "th", "host", "x.h", "x.words")
    lost = _met(held, heavy, keep_first, "inner", "host", "h", "doc_id", "th").groupBy("doc_id", "th", "host").agg(F.sum("words").alias("lost"))
    joined = rules.alias("r").join(lost.alias("l"), (F.col("r.th") == F.col("l.th")) & F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("r.host").eqNullSafe(F.col("l.host")), "left")
    left = F.col("n_words") - F.col("n_removed_words")
    verdicts = joined.select("r.doc_id", "r.host", "r.th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("lost", F.lit(0)).cast("long").alias("n_removed_words"))
    return verdicts.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (100 * left >= min_left * F.col("n_words"))), heavy


def quality_report(docs: DataFrame) -> DataFrame:
    """The verdicts of quality_verdicts, with its rules for nulls, repeats and empty tables, for the query."""
    return quality_verdicts(docs)[0].drop("host", "th")


def clean_documents(docs: DataFrame, keep_first: bool = False, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs without its rejected documents; those kept lose their frequent lines, and n_chars, where there is one, follows.

    Null and empty texts are rejected; null ids and hosts are values like others; rows that repeat an id, a host and a
    text stay repeated, or become one if they lose lines; all columns stay; an empty table gives an empty table.
    """
    verdicts, heavy = quality_verdicts(docs, max_docs, keep_first=keep_first)
    good = verdicts.filter("kept").select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("th").alias("__of"), F.col("n_removed_words").alias("__lost")).dropDuplicates(["__id", "__host", "__of"])
    own = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = own.join(good, (F.col("__th") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__host"))).select(*docs.columns, "__th", "__lost")
    whole = kept.filter("__lost = 0").select(*docs.columns)
    part = kept.filter("__lost > 0").drop("__lost").dropDuplicates(["doc_id", "source", "__th"])
    lines = part.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__of"), F.col("source").alias("__source"), F.posexplode(F.split("text", "\n")).alias("__at", "__line")).withColumn("__h", line_key(F.col("__line")))
    left = _met(lines, heavy, keep_first, "left_anti", "__source", "__h", "__id", "__of")
    ordered = F.sort_array(F.collect_list(F.struct("__at", "__line")))
    text = left.groupBy("__id", "__of", "__source").agg(F.array_join(F.transform(ordered, lambda x: x["__line"]), "\n").alias("__text"))
    part = part.join(text, (F.col("__th") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return whole.union(part.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns)))
