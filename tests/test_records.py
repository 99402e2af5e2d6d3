"""References resolved with whole records, on hand-written indexes."""

import datetime

import pytest
from pyspark.sql import functions as F

from reedbed.functions.text import WORK
from reedbed.operators import references as R

REFS = "id long, raw string, title string, year int, doi string, arxiv_id string"
NAMES = ["title", "authors", "year", "venue", "abstract", "citations", "doi", "url", "pdf_url", "source"]


def index(spark, rows):
    """Works (id, title, year, doi, venue, citations, source)."""
    kind = f"id long, record {WORK}"
    return spark.createDataFrame([(i, (title, ["A"], year, venue, None, cited, doi, None, None, source)) for i, title, year, doi, venue, cited, source in rows], kind)


@pytest.fixture(scope="module")
def indexes(spark):
    first = [
        (1, "Graph attention networks for molecules", 2018, "10.1/gat", "", None, "one"),
        (2, "Layer normalization of deep recurrent nets", 2015, "10.1/ln", "ICML", 0, "one"),
        (3, "Sorting very large tables quickly", 2001, "", "VLDB", 5, "one"),
        (4, "Bloom filters in practice today", 1990, "10.1/bf", "CACM", 1, "one"),
    ]
    second = [
        (11, "Graph attention networks for molecules", 2019, "https://doi.org/10.1/GAT", "Journal", 40, "two"),
        (12, "An entirely different paper about birds", 2015, "10.1/ln", "Birds", 9, "two"),
        (13, "Sorting very large tables quickly", 2003, "10.2/sort", "TODS", 7, "two"),
        (14, "Attention is what you need", 2017, "10.48550/arXiv.1706.03762", "NeurIPS", 99, "two"),
        (15, "Streams with bounded memory everywhere", 2010, "10.2/st", "SIGMOD", 3, "two"),
    ]
    return index(spark, first), index(spark, second)


REFERENCES = [
    (1, "Velickovic: Graph attention networks for molecules. 2018.", None, 2018, None, None),
    (2, "Ba: Layer normalization of deep recurrent nets. 2015. arXiv preprint arXiv:1607.06450", None, 2015, None, None),
    (3, "Sorting very large tables quickly, 2003", "Sorting very large tables quickly", 2003, None, None),
    (4, "Vaswani et al. Attention is what you need. 2017", None, 2017, None, " arXiv:1706.03762 "),
    (5, "Bloom filters in practice today", None, 2005, None, None),
    (6, "Streams with bounded memory everywhere. 2011", "Streams with bounded memory everywhere", 2011, "10.1/bf", None),
    (7, None, None, None, None, None),
    (8, "short", None, None, None, None),
    (9, "Nothing that any index has ever heard", None, None, None, None),
]


def outcome(spark, indexes, available):
    out = R.resolve_records(spark.createDataFrame(REFERENCES, REFS), *indexes, second_available=available)
    return {r["id"]: (r["status"], r["via"], r["work_id"], r["enriched"], r["record"] and (r["record"]["year"], r["record"]["venue"], r["record"]["citations"], r["record"]["source"])) for r in out.collect()}


def test_records(spark, indexes):
    got = outcome(spark, indexes, True)
    assert got == {
        1: ("ok", "first", 1, True, (2018, "Journal", 40, "two")),  # merged, with the year that is printed
        2: ("ok", "first", 2, False, (2015, "ICML", 0, "one")),  # the merged record would be another paper
        3: ("ok", "second", 13, False, (2003, "TODS", 7, "two")),  # the first index has it, two years off
        4: ("ok", "arxiv", 14, False, (2017, "NeurIPS", 99, "two")),
        5: ("miss", None, None, False, None),  # fifteen years off
        6: ("ok", "second", 15, False, (2010, "SIGMOD", 3, "two")),  # its DOI is not in the second index
        7: ("miss", None, None, False, None),
        8: ("miss", None, None, False, None),
        9: ("miss", None, None, False, None),
    }


def test_outage(spark, indexes):
    got = outcome(spark, indexes, False)
    assert {i: g[:2] for i, g in got.items()} == {1: ("ok", "first"), 2: ("ok", "first"), 3: ("ok", "first"), 4: ("error", None), 5: ("error", None), 6: ("error", None), 7: ("miss", None), 8: ("miss", None), 9: ("error", None)}
    assert got[1][3:] == (False, (2018, "", None, "one"))


def test_errors_stay_in_the_queue(spark, indexes):
    none = F.lit(None).cast("string")
    refs = spark.createDataFrame(REFERENCES, REFS).withColumns({"resolved_status": none, "resolved_at": F.lit(None).cast("timestamp_ntz"), "resolution": none})
    now = F.lit(datetime.datetime(2024, 1, 2)).cast("timestamp_ntz")
    kept = R.store_records(refs, R.resolve_records(refs, *indexes, second_available=False), now)
    assert kept.columns == refs.columns
    queue = R.resolution_queue(kept)
    assert sorted(r["id"] for r in queue.collect()) == [4, 5, 6, 9]
    again = R.store_records(kept, R.resolve_records(queue, *indexes), now)
    assert sorted(r["id"] for r in again.filter("resolved_status = 'ok'").collect()) == [1, 2, 3, 4, 6]
    assert again.filter("id = 3").select(F.get_json_object("resolution", "$.venue").alias("v")).first()["v"] == "VLDB"
    assert R.resolve_records(refs.limit(0), *indexes).count() == 0


def test_lines_are_cut_once(spark, indexes):
    """Each printed line is taken once for each text that is searched by, however many steps ask for its words."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(x):
        reads.add(1)
        return x

    refs = spark.createDataFrame(REFERENCES, REFS).localCheckpoint().withColumn("raw", line("raw"))
    for available, most in ((True, 2), (False, 1)):
        reads.value = 0
        out = R.resolve_records(refs, *indexes, second_available=available)
        assert out.count() == len(REFERENCES) and 0 < reads.value <= most * len(REFERENCES)
    works = indexes[0].select("id", "record.doi", "record.title", "record.year", F.lit(0).alias("source_rank"))
    reads.value = 0
    out = R.resolve_references(refs, works)
    assert {r["id"] for r in out.filter("status = 'ok'").collect()} == {1, 2, 3} and 0 < reads.value <= len(REFERENCES)
