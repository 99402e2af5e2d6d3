"""Hot pages, places in orders, fan-out in blocks, stored files and rejected lines."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reedbed.operators import inbox, library, marks, references
from reedbed.sources import tables as IO


def near(points, x, y, reach):
    for k, (ax, ay) in enumerate(points):
        bx, by = points[min(k + 1, len(points) - 1)]
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / length)) if length else 0.0
        if (ax + t * dx - x) ** 2 + (ay + t * dy - y) ** 2 <= reach * reach:
            return True
    return False


@pytest.mark.parametrize("reach", [0.002, 0.05, 0.6])
def test_ink_hits(spark, reach):
    """Short, long, single-point and empty strokes, pointers on the edges of cells and of the page."""
    draw = random.Random(1)
    strokes = [(k, k % 2, 1, [(draw.random(), draw.random()) for _ in range(draw.choice([0, 1, 2, 5]))]) for k in range(120)] + [(500, 0, 1, [(0.0, 0.0), (1.0, 1.0)]), (501, 0, 1, None)]
    pointers = [(k, k % 2, 1, draw.random(), draw.random()) for k in range(80)] + [(900 + k, 0, 1, k / 4, k / 4) for k in range(5)]
    df = spark.createDataFrame([(*s[:3], None if s[3] is None else [{"x": x, "y": y} for x, y in s[3]]) for s in strokes], "id long, edition_id long, page int, points array<struct<x:double,y:double>>")
    got = {tuple(r) for r in marks.ink_hits(spark.createDataFrame(pointers, "pointer_id long, edition_id long, page int, px double, py double"), df, reach).collect()}
    assert got == {(p, s) for p, e, g, x, y in pointers for s, f, h, points in strokes if (e, g) == (f, h) and points and near(points, x, y, reach)} and got


def test_one_page_of_very_many_strokes(spark):
    """10^5 strokes and 2,000 pointers on one page: cells keep the pairs that meet near the number of strokes."""
    spot = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10_000)) / 10_000
    strokes = spark.range(100_000).select("id", F.lit(1).alias("edition_id"), F.lit(1).alias("page"), F.array(F.struct(spot(1).alias("x"), spot(2).alias("y")), F.struct((spot(1) + 0.001).alias("x"), spot(2).alias("y"))).alias("points"))
    pointers = spark.range(2_000).select(F.col("id").alias("pointer_id"), F.lit(1).alias("edition_id"), F.lit(1).alias("page"), spot(3).alias("px"), spot(4).alias("py"))
    hits = marks.ink_hits(pointers, strokes, 0.002)
    n = hits.count()
    assert 1500 < n < 6000
    few = strokes.limit(100_000).join(pointers.filter("pointer_id < 3"), ["edition_id", "page"])
    x, y = F.get("points", F.lit(0))["x"], F.get("points", F.lit(0))["y"]
    along = F.greatest(F.lit(0.0), F.least(F.lit(0.001), F.col("px") - x))
    want = few.filter((x + along - F.col("px")) ** 2 + (y - F.col("py")) ** 2 <= 0.002**2).select("pointer_id", "id")
    assert sorted(map(tuple, hits.filter("pointer_id < 3").collect())) == sorted(map(tuple, want.collect()))


def test_links_on_a_page_of_many_references(spark):
    draw = random.Random(2)
    refs = [(k, 1, 1, None if k % 50 == 0 else draw.choice([draw.random(), 0.072 * draw.randrange(12), 0.5])) for k in range(300)]
    links = [(k, 1, 1, None if k % 40 == 0 else draw.choice([draw.random(), 0.072 * draw.randrange(12) + 0.012, 0.44, 0.512])) for k in range(200)]
    kind = "id long, edition_id long, page int, y double"
    got = {tuple(r) for r in references.link_references(spark.createDataFrame(links, kind), spark.createDataFrame(refs, kind)).collect()}
    want = set()
    for i, _, _, y in links:
        fits = [(abs(r - y), k) for k, _, _, r in refs if y is not None and r is not None and references.ABOVE <= r - y <= references.BELOW]
        if fits:
            want.add((i, min(fits)[1]))
    assert got == want and len(want) > 100


def test_places_follow_orders(spark):
    at = datetime.datetime(2024, 1, 1)
    draw = random.Random(3)
    rows = [(k, at + datetime.timedelta(days=draw.randrange(4)), draw.choice(["open", "planning", "scheduled", "finished", None]), [{"name": "r"}] * draw.randrange(3), draw.choice([None, 1.5, 3.0]), draw.choice([None, 0, 2001]), draw.choice([None, "b", "A", "a", "É", "e"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, status string, readers array<struct<name:string>>, merit double, year int, title string")
    places = {}
    for r in library.library_places(df).collect():
        places.setdefault(r["mode"], {})[r["place"]] = r["id"]
    for mode in library.ORDERS:
        assert [places[mode][k] for k in range(1, 61)] == [r["id"] for r in library.library_order(df, mode).collect()]
    assert places["activity"][1] in {r[0] for r in rows if r[2] in ("open", "planning")}


def test_fanout_in_blocks(spark):
    users = spark.createDataFrame([(k, k % 2 == 0, k == 4) for k in range(40)], "id long, is_admin boolean, is_deleted boolean")
    reports = spark.createDataFrame([(k,) for k in (7, 8)], "id long")
    want = sorted((r, u) for r in (7, 8) for u in range(0, 40, 2) if u != 4)
    for block in (10_000, 3):
        assert sorted(tuple(r) for r in inbox.feedback_fanout(reports, users, block).collect()) == want
    assert inbox.feedback_fanout(reports, users.limit(0)).count() == inbox.feedback_fanout(reports.limit(0), users).count() == 0


def test_files_are_stored_once(spark, tmp_path):
    for k, body in enumerate([b"one", b"two", b"one", b"\0\xff"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.pdf").write_bytes(body)
    store = f"{tmp_path}/store"
    first = IO.store_files(IO.read_files(spark, f"{tmp_path}/in"), store)
    assert [r["stored"] for r in first.orderBy("path").collect()] == [True, True, False, True]
    (tmp_path / "in" / "9.pdf").write_bytes(b"nine")
    again = IO.store_files(IO.read_files(spark, f"{tmp_path}/in"), store)
    assert [r["stored"] for r in again.orderBy("path").collect()] == [False] * 4 + [True]
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(store).collect()) == [b"\0\xff", b"nine", b"one", b"two"]
    assert IO.store_files(IO.read_files(spark, f"{tmp_path}/in").limit(0), store).count() == 0


def test_broken_lines_are_rejected(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "email": "a"}\n{"id": 2, "email"\n{"id": "x"}\n[1]\n{"id": 3, "more": 1}\n')
    rows, rejects = IO.read_with_rejects(spark, f"{tmp_path}/a.json", "users", "json")
    assert [(r["id"], r["email"], r["is_admin"]) for r in rows.orderBy("id").collect()] == [(1, "a", None), (3, None, None)]
    assert sorted(r["line"] for r in rejects.collect()) == ['[1]', '{"id": "x"}', '{"id": 2, "email"']
    (tmp_path / "b.csv").write_text("key,value\nsite,one\nonly\n")
    rows, rejects = IO.read_with_rejects(spark, f"{tmp_path}/b.csv", "settings", "csv")
    assert [tuple(r) for r in rows.collect()] == [("site", "one")] and [r["line"] for r in rejects.collect()] == ["only"]
