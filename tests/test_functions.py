"""Edge rows of the text functions and helpers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reedbed.functions import text as S
from reedbed.operators import identity, inbox, library, marks, ops, privacy, references, seminars
from reedbed.operators.seminars import SeminarState


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema or "x int").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("doi", "title", "key"),
    [(None, " A ", "title:a"), ("", "\tTitle ", "title:title"), ("  ", "x", "doi:"), (" 10.1/AbC ", "x", "doi:10.1/abc"), (None, None, "title:")],
)
def test_paper_key(spark, doi, title, key):
    assert one(spark, S.paper_key("doi", "title"), doi=("string", doi), title=("string", title)) == key


def test_dois(spark):
    assert one(spark, S.normalize_doi("c"), c=("string", " https://doi.org/10.1/A ")) == "10.1/a"
    assert one(spark, S.arxiv_as_doi("c"), c=("string", "arXiv:1607.06450 ")) == "10.48550/arxiv.1607.06450"
    for text, want in (("see 10.1234/a.b.).", "10.1234/a.b"), ('"10.1234/x"', "10.1234/x"), ("10.12/x", None)):
        assert one(spark, S.first_doi("c"), c=("string", text)) == want


def test_doi_on_fourth_page_is_not_seen(spark):
    pages = spark.createDataFrame([(1, 3, "10.1234/late"), (1, 0, "a"), (1, 2, "c"), (1, 1, "b")], "doc_id long, page_num int, text string")
    got = identity.first_pages_text(pages).first()
    assert got["text"] == "a\nb\nc"


def test_titles_and_years(spark):
    assert one(spark, S.title_from_filename("c"), c=("string", "3d_shape-nets.pdf")) == "3D Shape Nets"
    assert one(spark, S.plausible_year(F.col("a"), F.col("b")), a=("string", "0190"), b=("string", "2016. 190")) == 2016
    assert one(spark, S.match_query("c"), c=("string", "Layer norm. arXiv preprint arXiv:1607.06450 (2016)")).startswith("Layer norm. ")
    same = S.title_matches("c", "raw", "t")
    assert not one(spark, same, c=("string", "Graph Attention Networks"), raw=("string", "Structured attention networks"), t=("string", None))
    assert one(spark, same, c=("string", "Structured attention networks"), raw=("string", "Kim: Structured atten-\ntion networks."), t=("string", None))


def test_slug_and_statements(spark):
    assert S.slugify("Ünïted  States_of -- Art!") == "united-states-of-art"
    assert S.slugify("漢字") == "paper"
    op, table = S.classify_statement("c")
    for text, want in (("PRAGMA table_info(x)", ("PRAGMA", "-")), ("SELECT 1", ("SELECT", "-")), ("  ", ("OTHER", "-")), ('delete from "a"', ("DELETE", "a")), ("UPDATE OR IGNORE u SET a=1", ("UPDATE", "u"))):
        assert (one(spark, op, c=("string", text)), one(spark, table, c=("string", text))) == want


def test_urls_and_authors(spark):
    for url, want in (("javascript:x", None), ("/a", None), ("mailto:a@b", "mailto:a@b"), ("HTTP://x", "HTTP://x")):
        assert one(spark, S.safe_url("c"), c=("string", url)) == want
    for text, want in ((None, []), ("", []), ('["A","B"]', ["A", "B"]), ("A, B", ["A, B"]), ('"A"', ["A"])):
        assert one(spark, S.authors_list("c"), c=("string", text)) == want


def test_seminar_rules():
    s = SeminarState()
    assert s.apply("call", 1, True) == ""
    assert s.apply("call", 2, True)
    assert s.apply("lead", 2, True) == "not a member"
    assert s.apply("join", 2, True) == "" and s.apply("lead", 2, True) == ""
    assert s.apply("announce", 1, True) == "not the leader"
    assert s.apply("announce", 2, True) == "" and s.apply("unhost", 2, True) == "not in planning"
    assert s.apply("announce", 2, True) == "" and s.status == "scheduled"
    assert s.apply("leave", 2, True) == "no successor"
    assert s.apply("leave", 2, True, 1) == "" and s.leader == 1
    assert s.apply("call", 3, True) == "" and s.room == 2


def test_thinning():
    base = pd.Timestamp("2024-01-01")
    times = [base + pd.Timedelta(seconds=s) for s in (0, 30, 59, 60, 119, 120)]
    keep, _, _ = ops.kept_uses(None, False, iter(times), iter([False] * 6))
    assert [k for k, x in enumerate(keep) if x] == [0, 3, 5]
    keep, _, _ = ops.kept_uses(None, False, iter(times), iter([False, False, True, False, False, False]))
    assert keep == [True] + [False] * 5


def test_file_names():
    assert privacy.named_files([("X", 2000), ("X", 2000), ("X 2000", None), ("X-2000 2", None), ("X", 2000)]) == ["x-2000.pdf", "x-2000-2.pdf", "x-2000-3.pdf", "x-2000-2-2.pdf", "x-2000-4.pdf"]


def test_room_status_ties(spark):
    rooms = spark.createDataFrame([(1, "k", "open", 5), (2, "k", "finished", 5)], "id long, paper_key string, status string, created_at long")
    assert library.room_status(rooms).first()["status"] == "finished"


def test_link_window(spark):
    links = spark.createDataFrame([(1, 1, 1, 0.5)], "id long, edition_id long, page int, y double")
    ref = lambda *ys: spark.createDataFrame([(k, 1, 1, 0.5 + y) for k, y in enumerate(ys)], "id long, edition_id long, page int, y double")
    assert references.link_references(links, ref(-0.013)).count() == 0
    assert references.link_references(links, ref(-0.0119)).count() == 1
    assert references.link_references(links, ref(0.05, 0.01, -0.005)).first()["ref_id"] == 2


def test_boxes_and_markers(spark):
    coords = spark.createDataFrame([(1, 1, "1,10,20,30,40;bad;2,1,1,1,1")], "id long, edition_id long, coords string")
    sizes = spark.createDataFrame([(1, 1, 100.0, 200.0)], "edition_id long, page int, width double, height double")
    assert [tuple(r) for r in references.page_boxes(coords, sizes).collect()] == [(1, 1, 1, 0.1, 0.1, 0.3, 0.2)]
    refs = spark.createDataFrame([(10 + k, 1, f"b{k}", k) for k in range(9)], "id long, edition_id long, key string, index int")
    labels = ["[8]", "(3)", "[9,", "Curry [2]", "1985", "[10]"]
    marks_ = spark.createDataFrame([(k, 1, None, x) for k, x in enumerate(labels)], "id long, edition_id long, target string, label string")
    got = {r["marker_id"]: r["reference_id"] for r in references.numbered_targets(marks_, refs).collect()}
    assert got == {0: 17, 1: 12, 2: 18, 3: 11}


def test_best_candidate(spark):
    rows = [(1, 5, 3.0, 0, 1), (1, 6, 0.0, 0, 2), (2, 7, 2.0, 0, 1), (3, 8, 4.0, 0, 1), (4, 9, 1.5, 0, 1), (4, 10, 1.0, 1, 3)]
    cands = spark.createDataFrame(rows, "id long, work_id long, distance double, source_rank int, rank int")
    assert {r["id"]: r["work_id"] for r in references.best_candidate(cands).collect()} == {1: 6, 2: 7, 4: 10}


def test_successor_and_marks(spark):
    rooms = spark.createDataFrame([(1, "k", 7, "planning"), (2, "k", 7, "finished"), (3, "z", 7, "scheduled")], "id long, paper_key string, leader_id long, status string")
    members = spark.createDataFrame([(1, 1, 7, 1), (2, 1, 8, 2), (3, 1, 9, 3), (4, 3, 7, 1)], "id long, room_id long, user_id long, created_at long")
    eligible = spark.createDataFrame([("k", 9), ("k", 8)], "paper_key string, user_id long")
    got = {r["room_id"]: r["new_leader"] for r in seminars.successors(rooms, members, eligible, spark.createDataFrame([(7,)], "user_id long")).collect()}
    assert got == {1: 8, 3: None}
    notes = spark.createDataFrame([(1, 1, 1, True), (2, 1, 1, True), (3, 1, 1, False)], "id long, paper_id long, user_id long, current_place boolean")
    assert sorted(r["id"] for r in marks.current_place(notes, ["id"]).collect()) == [2, 3]


def test_digest_bounds(spark):
    rows = [(1, 1, "a", False, False, "2024-01-01 21:00:00"), (2, 1, "b", False, True, "2024-01-02 20:00:00"), (3, 2, "c", False, False, "2024-01-01 20:59:59")]
    n = spark.createDataFrame(rows, "id long, user_id long, content string, read boolean, emailed boolean, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    users = spark.createDataFrame([(1, "a@b", "A"), (2, "c@d", "C")], "id long, email string, display_name string")
    got = inbox.digest(n, users, F.lit("2024-01-02 21:00:00").cast("timestamp_ntz")).collect()
    assert [(r["user_id"], r["n"], r["subject"]) for r in got] == [(1, 1, "the library: 1 new message today")]


def test_canonicalize_is_idempotent(spark):
    rows = [(1, "10.1/A", "x", None, None, 2000, 1), (2, " 10.1/a", "y", None, None, 2001, 2), (3, None, "T ", None, None, 2002, 3), (4, "", "t", None, None, None, 4)]
    e = spark.createDataFrame(rows, "id long, doi string, title string, authors string, journal string, year int, created_at long")
    papers, mapping = identity.canonicalize(e)
    assert {r["entry_id"]: r["paper_id"] for r in mapping.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    again, _ = identity.canonicalize(papers.drop("paper_key"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, papers.select(again.columns).collect()))


def test_library_orders(spark):
    rows = [(1, "b", "finished", 3.0, 1990, 1, ["x"]), (2, "A", "open", None, None, 2, []), (3, "c", None, 5.0, 2000, 3, ["x", "y"])]
    listing = spark.createDataFrame(rows, "id long, title string, status string, merit double, year int, created_at long, readers array<string>")
    want = {"activity": [2, 3, 1], "newest": [3, 2, 1], "readers": [3, 1, 2], "merit": [3, 1, 2], "year": [3, 1, 2], "title": [2, 1, 3]}
    for mode, ids in want.items():
        assert [r["id"] for r in library.library_order(listing, mode).collect()] == ids, mode
