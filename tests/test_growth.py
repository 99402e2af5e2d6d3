"""What is shuffled, held and tried grows with the rows, not with their pairs."""

import datetime
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from reedbed.functions.text import title_from_filename
from reedbed.operators import identity, inbox, library, privacy, references, seminars, title_search
from reedbed.plans.queries import queries


def test_title_pairs_stay_in_their_task(spark):
    """1,000 queries and 1,000 titles with one word in common give out k titles of a query, not all."""
    refs = spark.range(1000).select("id", F.array(F.lit(1).cast("long"), F.col("id") + 10).alias("words"))
    titles = spark.range(1000).select(F.col("id").alias("work_id"), F.array(F.lit(1).cast("long"), F.col("id") + 5000).alias("words"))
    index = title_search.TitleIndex(titles, 5)
    asked = index._asked(refs)
    floors = asked.select("id", F.lit(0).alias("floor"), F.lit(0).alias("bound"))
    assert index.pairs(asked, floors).count() == 5000
    assert {r["work_id"] for r in index.top(refs).collect()} == set(range(5))


def test_title_blocks_against_all_pairs():
    draw = random.Random(5)
    titles = [sorted(draw.sample(range(40), draw.randrange(1, 9))) for _ in range(300)]
    asked = [sorted(draw.sample(range(60), draw.randrange(0, 30))) for _ in range(60)]
    block = title_search._Block(pa.table({"first": pa.array(range(300), pa.int64()), "words": pa.array(titles, pa.list_(pa.int64()))}), 5)
    for floor, bound in ((0, 0), (3, 100)):
        table = pa.table({"id": pa.array(range(60), pa.int64()), "words": pa.array(asked, pa.list_(pa.int64())), "floor": np.full(60, floor), "bound": np.full(60, bound)})
        want = []
        for i, words in enumerate(asked):
            counts = sorted((-len(set(words) & set(t)), k) for k, t in enumerate(titles) if set(words) & set(t))
            want += [(i, k, -n) for n, k in counts[:5] if (n, k) <= (-floor, bound)]
        assert [tuple(r.values()) for r in block.search(table).to_pylist()] == want and want


def test_links_and_references_of_one_place_are_paired_once(spark):
    """Both sides are cut to distinct places before they meet."""
    rows = spark.range(3000).select("id", F.lit(1).alias("edition_id"), F.lit(1).alias("page"), (F.col("id") % 3 / 64).alias("y"))
    hits = references.link_references(rows, rows)
    assert {(r["link_id"] % 3, r["ref_id"]) for r in hits.collect()} == {(0, 0), (1, 1), (2, 2)} and hits.count() == 3000
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 4


def test_many_copies_of_one_title_are_named_in_order():
    start = time.process_time()
    names = privacy.named_files([("Same title", 2000)] * 20_000)
    assert names[0] == "same-title-2000.pdf" and names[-1] == "same-title-2000-20000.pdf" and len(set(names)) == 20_000
    assert time.process_time() - start < 5


def test_file_names_of_users_in_one_task(spark):
    rows = [(u, 10 * u + k, "A b", 2000 if k % 2 else None) for u in range(50) for k in range(4)]
    got = privacy.export_file_names(spark.createDataFrame(rows, "user_id long, copy_id long, title string, year int").coalesce(1))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted((u, 10 * u + k, ["a-b.pdf", "a-b-2000.pdf", "a-b-2.pdf", "a-b-2000-2.pdf"][k]) for u in range(50) for k in range(4))


def test_titles_are_made_one_by_one(monkeypatch):
    """No step goes over the texts of a whole batch, which would hold a copy of all of them."""
    monkeypatch.setattr(pd.Series, "str", property(lambda s: 1 / 0))
    assert title_from_filename.func(pd.Series(["a_b-c.d.pdf", None, "x\ny"])).tolist()[:1] == ["A B C.D"]


def test_abstracts_are_dealt_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["s13_rebuild_abstract"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b a"), (2, "")]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_canonical_entries_hold_what_a_query_needs(spark):
    from reedbed.plans.fixtures import Tables
    from reedbed.plans.queries_library import Canon

    c = Canon(Tables(spark, "/root/testdata/sf0.001"), "marketed")
    assert sorted(c.entries.columns) == ["id", "marketed", "paper_id", "paper_key", "user_id"]
    assert sorted(c.holdings.columns) == ["id", "marketed", "paper_id", "user_id"]


def _log(spark):
    """Outcomes of five papers, whose readers act in them, are members or successors, or none of these; some readers share all their papers."""
    draw, at = random.Random(7), datetime.datetime(2024, 1, 1)
    kinds = ["call", "lead", "unhost", "handover", "scheduled", "updated", None]
    rows = []
    for k in range(150):
        kind, paper = draw.choice(kinds), f"p{draw.randrange(5)}" if k % 40 else None
        rows.append((paper, 1, k, k % 9 > 0, kind, draw.choice([0, 1, 2, 20, 21, None]), draw.choice([3, 30, None]) if kind == "handover" else None, [draw.choice([0, 1, 2, 4, 22]) for _ in range(draw.randrange(4))], "noon", "here", at + datetime.timedelta(hours=draw.randrange(30))))
    outcomes = spark.createDataFrame(rows, "paper_key string, room int, seq long, accepted boolean, notice string, actor_id long, heir long, members array<long>, time string, platform string, created_at timestamp_ntz")
    reads = [(f"p{p}", u) for p in range(5) for u in range(12) if (p + u) % 3] + [("p1", 1), ("p2", None), ("p9", 5)]
    titles = spark.createDataFrame([(f"p{p}", f"T{p}") for p in range(4)], "paper_key string, title string")
    users = spark.createDataFrame([(u, f"U{u}") for u in range(15)], "id long, display_name string")
    told = set()
    for paper, _, seq, ok, kind, actor, heir, members, *_ in rows:
        if ok and kind and paper and actor is not None:
            to = {heir} if kind == "handover" else set(members) | ({u for p, u in reads if p == paper} if kind != "unhost" else set())
            told |= {(paper, seq, u) for u in to - {None, actor}}
    return outcomes, spark.createDataFrame(reads, "paper_key string, user_id long"), titles, users, told, {r[2]: r[-1] for r in rows}


def test_notices_of_all_readers_are_not_shuffled(spark):
    *given, told, _ = _log(spark)
    for block in (10_000, 2):
        out = seminars.route_notices(*given, block=block)
        rows = [(r["paper_key"], r["seq"], r["user_id"]) for r in out.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == told and len(told) > 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(users") < plan.index("Join")


def test_inbox_of_the_log_without_all_notices(spark):
    *given, told, at = _log(spark)
    texts = {(r["seq"], r["user_id"]): r["content"] for r in seminars.route_notices(*given).collect()}
    for n in (3, 50):
        want = []
        for user in {u for _, _, u in told}:
            own = sorted(((at[s], s) for _, s, u in told if u == user), reverse=True)[:n]
            want += [(user, s, texts[s, user], t, k + 1) for k, (t, s) in enumerate(own)]
        got = seminars.newest_notices(*given, n=n).select("user_id", "id", "content", "created_at", "rank").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_readers_bundle_without_texts(spark):
    """Sizes of a reader's export do not gather the texts of a reader who wrote very many notes in one task."""
    out = queries()["a19_export_bundle"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and "text:string" not in plan and "summary:string" not in plan


def test_fanout_takes_little_space(spark, tmp_path):
    """Rows that repeat in short turns are written small: under a third of a byte each; ids in turns of all admins take more."""
    users = spark.range(3000).select("id", F.lit(True).alias("is_admin"), F.lit(False).alias("is_deleted"))
    out = inbox.feedback_fanout(spark.range(500), users)
    out.write.parquet(f"{tmp_path}/out")
    assert out.distinct().count() == 1_500_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500_000
    assert inbox.feedback_fanout(spark.range(500), users, task_rows=100_000).rdd.getNumPartitions() == 15


def test_notices_take_little_space(spark, tmp_path):
    """Notices times readers in short turns of readers: under half a byte a row; all readers of a notice at once take several times that."""
    at = datetime.datetime(2024, 1, 1)
    rows = [("p1", 1, k, True, "call", 0, None, [0], None, None, at) for k in range(300)]
    outcomes = spark.createDataFrame(rows, "paper_key string, room int, seq long, accepted boolean, notice string, actor_id long, heir long, members array<long>, time string, platform string, created_at timestamp_ntz")
    readers = spark.range(20_000).select(F.lit("p1").alias("paper_key"), F.col("id").alias("user_id"))
    titles, users = spark.createDataFrame([("p1", "T")], "paper_key string, title string"), spark.range(1).select("id", F.lit("U").alias("display_name"))
    seminars.route_notices(outcomes, readers, titles, users).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 300 * 19_999
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3_000_000


def test_files_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, k % 5) for k in range(40)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    tasks, write = [], DataFrameWriter.text

    def note(writer, *args, **kwargs):
        tasks.append(writer._df.rdd.getNumPartitions())
        return write(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", note)
    assert queries()["io3_store_files"](spark, str(tmp_path)).count() == 40
    assert tasks == [spark.sparkContext.defaultParallelism]


def test_recipients_are_not_shuffled(spark):
    """Readers of a room's paper and its members, without actors; rooms times readers is made by the last join."""
    rooms = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, paper_key string")
    reads = [("a", 10), ("a", 10), ("a", 11), ("b", 12), ("c", 13), ("a", None)]
    members = [(1, 10), (1, 14), (1, 14), (3, 10), (4, 15), (9, 16), (9, 17), (2, None)]
    actors = [(1, 11), (1, 14), (2, None), (3, 12), (9, 17)]
    out = seminars.recipients(rooms, spark.createDataFrame(reads, "paper_key string, user_id long"), spark.createDataFrame(members, "room_id long, user_id long"), spark.createDataFrame(actors, "room_id long, actor_id long"))
    own = {1: "a", 2: "a", 3: "b"}
    want = ({(r, u) for r, p in own.items() for q, u in reads if p == q} | set(members)) - set(actors) | {(2, None)}
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate [room_id" not in plan.split("Join")[0]


def test_seminars_need_no_canonical_papers(spark, tmp_path):
    """Who reads a paper is found by its key: one grouping of the entries, which are not written themselves."""
    from reedbed.plans.fixtures import Tables
    from reedbed.plans.queries_library import Canon

    t = Tables(spark, "/root/testdata/sf0.001")
    c = Canon(t, "marketed")
    assert sorted(c.holders.columns) == ["id", "marketed", "paper_key", "user_id"] and [k[0] for k in t.kept] == ["holders"]
    assert c.holders.join(c.papers.select("paper_key", F.col("id").alias("paper_id")), "paper_key").select("id", "paper_id").exceptAll(c.holdings.select("id", "paper_id")).isEmpty()


def test_lines_are_dealt_once(spark):
    from reedbed.plans.fixtures import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").sql("SELECT l_orderkey, max(l_suppkey) AS s FROM fx_line GROUP BY l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_choices_meet_editions_alone(spark):
    """A choice is looked up among editions before it meets the copies, so that whole copies are not dealt again for it."""
    copies = spark.createDataFrame([(k, 1, k, None, None) for k in range(5)], "id long, paper_id long, user_id long, edition_id long, ignored_edition_id long")
    editions = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "paper_id long, id long")
    choices = spark.createDataFrame([(1, 0, 7), (1, 1, 9), (1, 2, None)], "paper_id long, user_id long, choice long")
    out = library.adopt_editions(copies, choices, editions)
    got = [(r["id"], r["edition_id"], r["ignored_edition_id"], r["rejected"]) for r in out.orderBy("id").collect()]
    assert got == [(0, 7, 8, False), (1, None, None, True), (2, 8, 8, False), (3, None, None, False), (4, None, None, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "choice" not in plan[plan.index("Join") :].split("\n")[0]


def test_canonical_tables_are_rows_of_one(spark):
    """Papers, editions and copies come from entries that are dealt and written once; the steps by themselves give the same."""
    from reedbed.operators import identity
    from reedbed.plans.fixtures import Tables
    from reedbed.plans.queries_library import Canon

    t = Tables(spark, "/root/testdata/sf0.001")
    c = Canon(t, "sha256", "summary")
    named = identity.name_entries(c.entries.drop("paper_id"))
    steps = {"holdings": identity.first_copies(named), "editions": identity.dedup_editions(named), "entries": named}
    for name, want in steps.items():
        got = getattr(c, name)
        assert sorted(got.columns) == sorted(want.columns) and got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
    assert c.copies.count() == c.holdings.count() and [k[0] for k in t.kept] == ["placed"]


def test_entries_of_one_paper_are_placed(spark):
    rows = [(3, 1, "a", "x"), (1, 1, "a", "y"), (2, None, "a", "x"), (4, 2, "a", None), (5, 2, "b", None), (6, 2, "b", None)]
    placed = identity.place_entries(spark.createDataFrame(rows, "id long, user_id long, paper_key string, sha256 string"))
    got = {r["id"]: (r["paper_id"], r["own"], r["latest"], r["first"]) for r in placed.collect()}
    assert got == {1: (1, 1, 4, 1), 2: (1, 2, 4, 2), 3: (1, 2, 4, 1), 4: (1, 4, 4, 4), 5: (5, 5, 5, 5), 6: (5, 5, 5, 5)}
    assert {r["id"] for r in identity.placed_copies(placed.withColumn("marketed", F.lit(True))).collect()} == {1, 4, 5}


def _exchanges(spark, make):
    """How often a plan deals rows where nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_viewers_are_dealt_twice(spark):
    """Viewers of papers go by reader once and by paper once; what a paper has does not travel with them."""
    frame = lambda cols: spark.createDataFrame([], cols)
    given = (
        frame("user_id long, paper_id long"),
        frame("id long, paper_key string, title string"),
        frame("id long, paper_id long, user_id long, marketed boolean, is_author boolean, edition_id long, ignored_edition_id long, summary string"),
        frame("id long, paper_id long, user_id long, created_at date"),
        frame("id long, paper_key string, created_at date"),
        frame("paper_id long, id long"),
    )
    # Viewers, copies and notes by reader; papers and rooms by key; viewers, papers, counts and editions by paper.
    assert _exchanges(spark, lambda: library.paper_detail(*given)) == 9


def test_lists_of_a_paper_are_not_dealt_for_its_rooms(spark):
    frame = lambda cols: spark.createDataFrame([], cols)
    given = (
        frame("id long, paper_key string"),
        frame("id long, paper_id long, user_id long, marketed boolean, is_author boolean"),
        frame("id long, display_name string, affiliation string"),
        frame("paper_id long, sha256 string, id long"),
        frame("id long, paper_key string, created_at date, status string, creator string, leader string, n_members long"),
    )
    plan = library.paper_page(*given)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "paper_id" in joins[0] and "paper_key" in joins[2]
    assert _exchanges(spark, lambda: library.paper_page(*given)) == 7


def test_members_of_rooms_are_not_dealt_with_viewers(spark):
    """Members and creators as viewers: the same rows as from a table of them, with members dealt by room alone."""
    rooms = spark.createDataFrame([(1, "a", "open", 10), (2, "a", "open", 11), (3, "b", "planning", 12), (4, None, "open", None)], "id long, paper_key string, status string, created_by long")
    members = spark.createDataFrame([(1, 10), (1, 13), (1, 13), (2, 10), (3, None), (4, None), (9, 10)], "room_id long, user_id long")
    shown = spark.createDataFrame([("a", 10), ("b", 12), ("c", 13)], "paper_key string, user_id long")
    every = shown.union(spark.createDataFrame([("a", 13)], shown.schema))
    viewers = members.union(rooms.select("id", "created_by")).distinct()
    rows = lambda seen: sorted(map(str, seminars.room_detail(rooms, seen, shown, members, every).collect()))
    assert rows(None) == rows(viewers) and len(rows(None)) == 7
    plan = seminars.room_detail(rooms, None, shown, members, every)._jdf.queryExecution().optimizedPlan().toString()
    assert "created_by" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_readers_without_rooms_are_not_gathered(spark):
    """Entries meet the rooms' papers before they are grouped; the rows are those of all holders whose paper has a room."""
    from reedbed.plans.fixtures import Tables
    from reedbed.plans.queries_library import Canon

    t = Tables(spark, "/root/testdata/sf0.001")
    c = Canon(t, "marketed")
    got = c.holders_with(t.fx_rooms)
    assert [k[0] for k in t.kept] == ["room-keys", "room-holders"] or [k[0] for k in t.kept] == ["room-holders", "room-keys"]
    want = c.holders.join(t.fx_rooms, "paper_key", "left_semi").select(*got.columns)
    assert 0 < got.count() == want.count() < c.holders.count() and got.exceptAll(want).isEmpty()


def test_least_rows_of_numbers_are_hashed(spark):
    """A sort of all entries is spared where a copy or upload takes numbers alone; a null beside the least id stays."""
    rows = spark.createDataFrame([("a", 1, 2, True, "x"), ("a", 1, 1, None, "x"), ("b", 2, 3, False, "y")], "paper_key string, user_id long, id long, marketed boolean, sha256 string")
    copies, uploads = identity.first_copies(rows.drop("sha256"), "paper_key"), identity.first_uploads(rows)
    assert sorted(tuple(r) for r in copies.collect()) == [("a", 1, 1, True), ("b", 2, 3, False)]
    assert sorted((r["id"], r["user_id"]) for r in uploads.collect()) == [(1, 1), (3, 2)]
    assert not any("SortAggregate" in x._jdf.queryExecution().executedPlan().toString() for x in (copies, uploads))


def test_who_leaves_is_found_once(spark):
    """Tables meet the readers who leave as one small written table, and copies of those who stay are not grouped."""
    out = queries()["u09_erasure_report"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan
    groups = [line for line in plan.splitlines() if "Aggregate [paper_key" in line and "user_id" in line.split("]")[0]]
    below = plan[plan.index(groups[0]) :].splitlines()
    assert len(groups) == 1 and any("Join LeftSemi" in line for line in below[1:4])


def test_titles_of_common_words_are_counted_as_bits(monkeypatch):
    """Titles with common and rare words, over several stretches: the rows of all pairs, with few titles counted one by one."""
    draw = random.Random(11)
    titles = [sorted({*draw.sample(range(30), draw.randrange(12)), *(draw.randrange(30, 30_000) for _ in range(draw.randrange(1, 4)))}) for _ in range(40_000)]
    asked = [sorted({*draw.sample(range(30), 15), *draw.sample(titles, 1)[0], *(draw.randrange(30, 40_000) for _ in range(9))}) for _ in range(12)] + [[], [50_000]]
    block = title_search._Block(pa.table({"first": pa.array(range(40_000), pa.int64()), "words": pa.array(titles, pa.list_(pa.int64()))}), 5)
    counted, bincount = [], np.bincount

    def note(x, *args, **kwargs):
        counted.append(len(x))
        return bincount(x, *args, **kwargs)

    monkeypatch.setattr(np, "bincount", note)
    held = [set(t) for t in titles]
    for floor, bound in ((0, 0), (9, 20_000)):
        counted.clear()
        table = pa.table({"id": pa.array(range(14), pa.int64()), "words": pa.array(asked, pa.list_(pa.int64())), "floor": np.full(14, floor), "bound": np.full(14, bound)})
        got = [tuple(r.values()) for r in block.search(table).to_pylist()]
        want = []
        for i, words in enumerate(asked):
            counts = sorted((-len(t.intersection(words)), k) for k, t in enumerate(held) if not t.isdisjoint(words))
            want += [(i, k, -n) for n, k in counts[:5] if (n, k) <= (-floor, bound)]
        assert got == want and want and sum(counted) < 2000
