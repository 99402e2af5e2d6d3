"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, encoding, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reedbed.llm.byte_bpe import encode
from reedbed.llm.decontam import drop_contaminated
from reedbed.llm.ngram_join import ngram_components
from reedbed.llm.quality import clean_documents
from reedbed.llm.secrets import redact
from reedbed.llm.store import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's frequent lines; a page in very many copies keeps its first one.

    Null and empty texts go; rows without id or host are judged like others; an empty table stays empty.
    """
    return clean_documents(docs, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, with all its different texts; rows without id stay.

    Rows that repeat an id and a text become one; texts without words are in no group and stay; an empty table stays empty.
    """
    groups = ngram_components(docs, n=5, percent=80)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Rows without id go by their text; null texts stay; an empty table stays empty."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark. Nulls and repeated rows stay; an empty table stays empty."""
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed ids of every row; a null text has no ids; an empty table gives an empty table."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again by the next."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
