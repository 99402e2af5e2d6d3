"""Located notes and ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def notes_order(notes: DataFrame, reads: DataFrame) -> DataFrame:
    """notes by page (none last), time and id, with drifted: placed on another edition than their reader's copy reads.

    reads: paper_id, user_id, reads.
    """
    rows = notes.join(reads.select("paper_id", "user_id", "reads"), ["paper_id", "user_id"], "left")
    rows = rows.withColumn("drifted", F.col("edition_id").isNotNull() & F.col("reads").isNotNull() & (F.col("edition_id") != F.col("reads")))
    return rows.orderBy(F.asc_nulls_last("page"), *(["created_at"] if "created_at" in notes.columns else []), "id")


def notes_places(notes: DataFrame, reads: DataFrame) -> DataFrame:
    """notes_order with place, from 1, of each note among its reader's on its paper."""
    at = ["created_at"] if "created_at" in notes.columns else []
    order = W.partitionBy("paper_id", "user_id").orderBy(F.asc_nulls_last("page"), *at, "id")
    return notes_order(notes, reads).withColumn("place", F.row_number().over(order))


def current_place(notes: DataFrame, by: list[str]) -> DataFrame:
    """notes with one current-place mark for each (paper, user), the newest by the given columns; other notes stay."""
    best = notes.filter("current_place").groupBy("paper_id", "user_id").agg(F.max(F.struct(*by)).alias("b")).select("paper_id", "user_id", "b.*")
    stale = notes.filter("current_place").join(best, ["paper_id", "user_id", *by], "left_anti").select("id")
    return notes.join(stale, "id", "left_anti")


def notes_by_page(notes: DataFrame) -> DataFrame:
    """(edition_id, page, notes): located notes in id order."""
    return notes.filter("page is not null").groupBy("edition_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", "content"))).alias("notes"))


def ink_by_page(strokes: DataFrame) -> DataFrame:
    """(edition_id, page, strokes) in id order."""
    return strokes.groupBy("edition_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", "points"))).alias("strokes"))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def ink_hits(pointers: DataFrame, strokes: DataFrame, reach: float) -> DataFrame:
    """(pointer_id, stroke_id): strokes whose line passes within reach of a pointer on its page.

    pointers: pointer_id, edition_id, page, px, py. strokes: id, edition_id, page, points (array of x, y). A page is cut into
    square cells of some reaches; each segment of a stroke is dealt to the cells that its surroundings touch, and meets
    the pointers of the same cell, so that a page of very many marks is many small groups. A stroke without points, or a
    null coordinate, hits nothing; a single point is a segment of no length.
    """
    cell = max(4 * reach, 1 / 64)
    ends = F.arrays_zip(F.col("points").alias("a"), F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", F.size("points"), 1)).alias("b"))
    parts = strokes.filter(F.size("points") > 0).select("id", "edition_id", "page", F.explode(ends).alias("s")).select("id", "edition_id", "page", *(F.col(f"s.{e}.{axis}").alias(f"{e}{axis}") for e in "ab" for axis in "xy"))
    parts = parts.dropna(subset=["ax", "ay", "bx", "by"])
    for axis in "xy":
        low, high = F.least(f"a{axis}", f"b{axis}") - reach, F.greatest(f"a{axis}", f"b{axis}") + reach
        parts = parts.withColumn(f"c{axis}", F.explode(_cells(low, high, cell)))
    own = pointers.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    met = own.join(parts, ["edition_id", "page", "cx", "cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / length))).otherwise(F.lit(0.0))
    ex, ey = F.col("ax") + along * dx - F.col("px"), F.col("ay") + along * dy - F.col("py")
    return met.filter(ex * ex + ey * ey <= reach * reach).select("pointer_id", F.col("id").alias("stroke_id")).distinct()


def apply_ink_edits(strokes: DataFrame, edits: DataFrame, readable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strokes, rejected edits) after a log: seq, stroke_id, user_id, action, edition_id, page, points, color, width, opacity, shape.

    insert makes a stroke on an edition that the user may read (readable: edition_id, user_id); move puts new points in its
    place; delete rubs it out. Only a stroke's owner may move or delete it. The last move counts; a deleted stroke is gone
    whatever else is in the batch. An insert whose stroke_id is taken, here or by an earlier insert, is rejected.
    """
    fields = ["edition_id", "page", "points", "color", "width", "opacity", "shape"]
    taken = strokes.select(F.col("id").alias("stroke_id"))
    asked = edits.filter("action = 'insert'").join(taken, "stroke_id", "left_anti")
    made = asked.join(readable.select("edition_id", "user_id").distinct(), ["edition_id", "user_id"], "left_semi")
    first = made.groupBy("stroke_id").agg(F.min("seq").alias("seq"))
    made = made.join(first, ["stroke_id", "seq"], "left_semi")
    every = strokes.select("id", "user_id", *fields).union(made.select("stroke_id", "user_id", *fields))
    owners = every.select(F.col("id").alias("stroke_id"), F.col("user_id").alias("owner"))
    changes = edits.filter("action in ('move', 'delete')").join(owners, "stroke_id", "left").withColumn("good", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)))
    good = changes.filter("good")
    moved = good.filter("action = 'move'").groupBy(F.col("stroke_id").alias("id")).agg(F.max_by(F.struct("points"), "seq").alias("m"))
    gone = good.filter("action = 'delete'").select(F.col("stroke_id").alias("id")).distinct()
    after = every.join(gone, "id", "left_anti").join(moved, "id", "left")
    after = after.withColumn("points", F.when(F.col("m").isNotNull(), F.col("m.points")).otherwise(F.col("points"))).select("id", "user_id", *fields)
    accepted = made.select("seq").union(good.select("seq"))
    return after, edits.join(accepted, "seq", "left_anti").select("seq", "stroke_id", "user_id", "action")


def remove_from_shelf(copies: DataFrame, comments: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, comments) without the reader's copy and notes of each removed (paper_id, user_id)."""
    gone = removals.select("paper_id", "user_id")
    return copies.join(gone, ["paper_id", "user_id"], "left_anti"), comments.join(gone, ["paper_id", "user_id"], "left_anti")


def apply_mark_edits(marks: DataFrame, edits: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, rejected edits) after a log: seq, mark_id, user_id, action, sent_content, content, sent_name, name, page, paper_id.

    insert makes a mark (a placed one takes the edition that its reader's copy reads); change sets the fields sent; delete
    drops it. Only a mark's owner may change or delete it. Texts are stripped, a blank name is none; the last edit of a
    field counts.
    """
    own = marks.select(F.col("id").alias("mark_id"), F.col("user_id").alias("owner"))
    made = edits.filter("action = 'insert'").join(reads.select("paper_id", "user_id", "reads"), ["paper_id", "user_id"], "left")
    made = made.select(F.col("mark_id").alias("id"), "paper_id", "user_id", strip("content").alias("content"), F.nullif(strip("name"), F.lit("")).alias("name"), "page", F.when(F.col("page").isNotNull(), F.col("reads")).alias("edition_id"))
    owned = edits.filter("action <> 'insert'").join(own.union(made.select("id", "user_id")), "mark_id", "left").withColumn("good", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)))
    rejected = owned.filter("not good").select("seq", "mark_id", "user_id", "action")
    good = owned.filter("good")
    last = good.filter("action = 'change'").groupBy(F.col("mark_id").alias("id")).agg(
        F.max_by(F.struct(strip("content").alias("v")), F.when(F.col("sent_content"), F.col("seq"))).alias("c"),
        F.count_if("sent_content").alias("nc"),
        F.max_by(F.struct(F.nullif(strip("name"), F.lit("")).alias("v")), F.when(F.col("sent_name"), F.col("seq"))).alias("n"),
        F.count_if("sent_name").alias("nn"),
    )
    gone = good.filter("action = 'delete'").select(F.col("mark_id").alias("id")).distinct()
    every = marks.select("id", "paper_id", "user_id", "content", "name", "page", "edition_id").union(made)
    rows = every.join(last, "id", "left").join(gone, "id", "left_anti")
    return rows.select("id", "paper_id", "user_id", F.when(F.col("nc") > 0, F.col("c.v")).otherwise(F.col("content")).alias("content"), F.when(F.col("nn") > 0, F.col("n.v")).otherwise(F.col("name")).alias("name"), "page", "edition_id"), rejected
