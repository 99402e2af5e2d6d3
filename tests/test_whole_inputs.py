"""Registered queries hand whole texts and whole tables to their operators."""

import datetime

import duckdb
import pytest

from pyspark.sql import functions as F

from reedbed.operators import references, title_search
from reedbed.plans import queries_library
from reedbed.plans.queries import oracle_sql, queries


def test_title_from_filename_keeps_the_whole_text(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(2000))
    spark.createDataFrame([(1, text), (2, "a/b  c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["title"] for r in queries()["s05_title_from_filename"](spark, str(tmp_path)).collect()}
    assert got == {1: f"{text} 1d".title(), 2: "A B C 2D"}


def test_export_writes_every_user(spark, tmp_path, monkeypatch):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 5, "click", 1.0, "{}", at) for k in range(20)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    written, write = [], queries_library.IO.write_export

    def note(bundle, path):
        written.append(sorted(r["user_id"] for r in bundle.collect()))
        return write(bundle, path)

    monkeypatch.setattr(queries_library.IO, "write_export", note)
    got = queries()["io5_write_export"](spark, str(tmp_path)).collect()
    assert written == [[0, 1, 2, 3, 4]]
    assert sorted(tuple(r) for r in got) == [(k, 4, k, 15 + k) for k in range(5)]


def test_merged_works_of_texts_without_a_title(spark, tmp_path):
    """Texts that begin with a full stop or a new line, empty and missing ones, and odd ids: the rows of the SQL."""
    texts = [".a b", "\na", "", None, "a b. c", " .x"]
    rows = [(k - 6, texts[k % 6]) for k in range(60)] + [(None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, texts[k]) for k in range(6)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in queries()["u03_merge_works"](spark, str(tmp_path)).select("id", "title", "authors", "citations", "year").collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(f"select id, title, authors, citations, year from ({oracle_sql()['u03_merge_works']})").fetchall()))


@pytest.mark.parametrize("small", [False, True])
def test_candidates_are_the_best_of_all(spark, small, monkeypatch):
    """Every reference's best works, whatever is looked at first: against counts of common words, ties by work id."""
    if small:
        for name, value in (("SAMPLE", 3), ("RARE", 1), ("HEAD", 2), ("BLOCK", 2)):
            monkeypatch.setattr(title_search, name, value)
    word = lambda k: f"w{k}x"
    texts = [(k, " ".join(word((k * j + j * j) % 23) for j in range(1, 4 + k % 7)), None) for k in range(20)] + [(50, None, None), (51, "short", None), (52, None, "w1x w2x of a title")]
    texts += [(60 + k, " ".join([word(40)] * 3 + [word(41 + k)]), None) for k in range(4)]
    titles = [(100 + k, None, " ".join(word((3 * k + j) % 19) for j in range(k % 5)), 2000, 0) for k in range(25)]
    titles += [(200 - k, None, f"{word(40)} {word(41)}", 2000, 0) for k in range(9)] + [(300 + k, None, f"{word(40)} {word(60 + k)}", 2000, 0) for k in range(9)] + [(400, None, None, 2000, 0)]
    refs = spark.createDataFrame(texts, "id long, raw string, title string")
    works = spark.createDataFrame(titles, "id long, doi string, title string, year int, source_rank int")
    want = []
    for i, raw, title in texts:
        own = set(f"{raw or ''} {title or ''}".split())
        if len(title or raw or "") >= 8:
            found = sorted((-len(own & set((t or "").split())), w) for w, _, t, _, _ in titles if own & set((t or "").split()))[:5]
            want += [(i, w, -n, rank + 1) for rank, (n, w) in enumerate(found)]
    assert sorted(tuple(r) for r in references.candidates(refs, works).collect()) == sorted(want) and len(want) > 80
    assert references.candidates(refs.limit(0), works).count() == references.candidates(refs, works.limit(0)).count() == 0


def test_common_words_are_not_paired(spark):
    """A word of all titles and all references makes no pairs once k titles share more."""
    refs = spark.createDataFrame([(k, [1, *range(100 + 7 * (k % 10), 107 + 7 * (k % 10))]) for k in range(300)], "id long, words array<long>")
    titles = spark.createDataFrame([(k, [1, *range(100 + 7 * (k % 10), 105 + 7 * (k % 10))]) for k in range(60)] + [(1000 + k, [1, 10_000 + k]) for k in range(3000)], "work_id long, words array<long>")
    index = title_search.TitleIndex(titles, 5)
    asked = index._asked(refs)
    floors = index._floors(asked, index._verified(index._early(asked), asked))
    assert floors.agg(F.min("floor")).first()[0] == 6
    assert index.pairs(asked, floors).count() <= 300
    assert index.top(refs).groupBy("id").count().filter("count = 5").count() == 300
