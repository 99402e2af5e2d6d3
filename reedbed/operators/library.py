"""Library and shelves: what is on display, who reads it, and how it is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.shared import kept, scratch
from .identity import latest_edition
from .numbering import running_totals


def displayed_copies(copies: DataFrame) -> DataFrame:
    return copies.filter("marketed")


def visible_papers(papers: DataFrame, copies: DataFrame, viewer: int | None = None) -> DataFrame:
    """Papers that anyone displays, or that the viewer holds."""
    seen = F.col("marketed") if viewer is None else F.col("marketed") | (F.col("user_id") == viewer)
    return papers.join(copies.filter(seen).select(F.col("paper_id").alias("id")), "id", "left_semi")


def edition_for(copies: DataFrame, editions: DataFrame) -> DataFrame:
    """copies with reads, the edition each reads: the pinned one, else its paper's latest."""
    latest = latest_edition(editions.select("paper_id", "id")).withColumnRenamed("edition_id", "latest")
    return copies.join(latest, "paper_id", "left").withColumn("reads", F.coalesce("edition_id", "latest"))


def edition_offers(copies: DataFrame, editions: DataFrame) -> DataFrame:
    """Copies whose paper's latest edition is neither the one they read nor the one they waved away."""
    return edition_for(copies, editions).filter("latest is not null and not latest <=> reads and not latest <=> ignored_edition_id")


def _chosen(copies: DataFrame, choices: DataFrame, editions: DataFrame) -> DataFrame:
    """copies with latest, choice, asked and rejected. Only choices that name an edition meet the editions, and not as whole copies."""
    own = editions.select("paper_id", F.col("id").alias("choice"), F.lit(True).alias("exists"))
    asked = choices.select("paper_id", "user_id", "choice", F.lit(True).alias("asked"))
    named = asked.filter("choice is not null").join(own, ["paper_id", "choice"], "left").withColumn("rejected", F.col("exists").isNull())
    judged = named.select(*asked.columns, "rejected").union(asked.filter("choice is null").withColumn("rejected", F.lit(False)))
    return edition_for(copies, editions).join(judged, ["paper_id", "user_id"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def adopt_editions(copies: DataFrame, choices: DataFrame, editions: DataFrame) -> DataFrame:
    """copies after readers adopt an edition (choice, else the latest): it is pinned, and the latest counts as seen.

    choices: paper_id, user_id, choice. A choice that is not the paper's is rejected.
    """
    rows = _chosen(copies, choices, editions)
    ok = F.col("asked").isNotNull() & ~F.col("rejected")
    fields = {"edition_id": F.when(ok, F.coalesce("choice", "latest")).otherwise(F.col("edition_id")), "ignored_edition_id": F.when(ok, F.col("latest")).otherwise(F.col("ignored_edition_id"))}
    return rows.select(*(fields.get(c, F.col(c)).alias(c) for c in copies.columns), "rejected")


def ignore_editions(copies: DataFrame, choices: DataFrame, editions: DataFrame) -> DataFrame:
    """copies after readers wave an edition away (choice, else the latest)."""
    rows = _chosen(copies, choices, editions)
    ok = F.col("asked").isNotNull() & ~F.col("rejected")
    fields = {"ignored_edition_id": F.when(ok, F.coalesce("choice", "latest")).otherwise(F.col("ignored_edition_id"))}
    return rows.select(*(fields.get(c, F.col(c)).alias(c) for c in copies.columns), "rejected")


def public_user(user: str = "id") -> Column:
    return F.struct(F.col(user).alias("id"), F.col("display_name").alias("name"), "affiliation")


# What a reader says of a paper, and its type.
OPINIONS = {"thought": "string", "rating_expertise": "int", "rating_reading": "int", "rating_liking": "int"}


def _reader(copies: DataFrame) -> Column:
    said = [F.col(c) if c in copies.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPINIONS.items()]
    return F.struct(F.col("id").alias("copy_id"), F.col("user_id").alias("user_id"), F.col("display_name").alias("name"), "affiliation", "is_author", *said)


def readers_of(copies: DataFrame, users: DataFrame) -> DataFrame:
    """(paper_id, readers): the readers who display each paper, with thought and ratings, ordered by copy."""
    rows = displayed_copies(copies).join(users.select(F.col("id").alias("user_id"), "display_name", "affiliation"), "user_id")
    return rows.groupBy("paper_id").agg(F.sort_array(F.collect_list(_reader(copies))).alias("readers"))


def displays_of(copies: DataFrame, users: DataFrame) -> DataFrame:
    """(paper_id, readers, merit) of each displayed paper: readers_of and avg_merit in one pass over the copies. A copy whose user
    is unknown shows no reader, but its rating counts."""
    known = users.select(F.col("id").alias("user_id"), "display_name", "affiliation", F.lit(True).alias("__known"))
    rows = displayed_copies(copies).join(known, "user_id", "left")
    return rows.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.when(F.col("__known"), _reader(copies)))).alias("readers"), F.avg("rating_liking").alias("merit"))


def room_status(rooms: DataFrame) -> DataFrame:
    """(paper_key, status): the status of each paper's latest room by (created_at, id)."""
    return rooms.groupBy("paper_key").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"))


def directory(users: DataFrame, copies: DataFrame) -> DataFrame:
    """Live readers with the number of papers they display, by name."""
    shown = copies.groupBy(F.col("user_id").alias("id")).agg(F.count_if("marketed").alias("n_displayed"))
    return users.filter("not is_deleted").join(shown, "id", "left").select("id", "display_name", F.coalesce("n_displayed", F.lit(0)).alias("n_displayed")).orderBy("display_name", "id")


def shelf_stats(users: DataFrame, copies: DataFrame, comments: DataFrame, participants: DataFrame) -> DataFrame:
    """Per reader: papers, displayed papers, notes, seminars. Each table is counted before it is joined."""
    own = copies.groupBy("user_id").agg(F.count("*").alias("papers"), F.count_if("marketed").alias("displayed"))
    notes = comments.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("notes"))
    seminars = participants.groupBy("user_id").agg(F.countDistinct("room_id").alias("seminars"))
    out = users.select(F.col("id").alias("user_id"))
    for part in (own, notes, seminars):
        out = out.join(part, "user_id", "left")
    return out.na.fill(0, ["papers", "displayed", "notes", "seminars"])


def avg_merit(copies: DataFrame) -> DataFrame:
    """(paper_id, merit): the mean rating of those who display the paper; null if nobody rated it."""
    return displayed_copies(copies).groupBy("paper_id").agg(F.avg("rating_liking").alias("merit"))


def library(papers: DataFrame, copies: DataFrame, users: DataFrame, rooms: DataFrame, editions: DataFrame) -> DataFrame:
    """Every displayed paper once: readers, merit, seminar status and latest edition; newest first."""
    out = papers.join(displays_of(copies, users).withColumnRenamed("paper_id", "id"), "id")
    out = out.join(room_status(rooms), "paper_key", "left").join(latest_edition(editions).withColumnRenamed("paper_id", "id"), "id", "left")
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def shelf(copies: DataFrame, papers: DataFrame, rooms: DataFrame, editions: DataFrame, viewer: int | None = None) -> DataFrame:
    """Copies as their owner's shelf shows them to the viewer: others see what is displayed, and no summary."""
    own = F.col("user_id").eqNullSafe(F.lit(viewer))
    rows = edition_for(copies, editions).filter(own | F.col("marketed"))
    rows = rows.join(papers.select(F.col("id").alias("paper_id"), "paper_key", F.col("title").alias("paper_title")), "paper_id").join(room_status(rooms), "paper_key", "left")
    return rows.withColumn("summary", F.when(own, F.col("summary"))) if "summary" in copies.columns else rows


def library_search(listing: DataFrame, term: str, with_readers: bool = True) -> DataFrame:
    """Rows that hold the term in title, authors, journal or, if asked, a reader's name; letter case does not count."""
    t = F.lit(term.strip().lower())
    hit = F.lit(False)
    for c in ("title", "authors", "journal"):
        hit = hit | F.coalesce(F.lower(c).contains(t), F.lit(False))
    if with_readers:
        hit = hit | F.exists("readers", lambda r: F.coalesce(F.lower(r["name"]).contains(t), F.lit(False)))
    return listing.filter(hit)


# Rank of a seminar's status in listings; every other status, and none, comes after them.
STATUS_RANK = {"open": 0, "planning": 0, "scheduled": 1}
ORDERS = ("activity", "newest", "readers", "merit", "year", "title")


def status_rank(status: Column) -> Column:
    rank = F.lit(2)
    for name, k in STATUS_RANK.items():
        rank = F.when(status == name, F.lit(k)).otherwise(rank)
    return rank


def _order(mode: str) -> list[Column]:
    newest = [F.desc("created_at"), F.desc("id")]
    first = {
        "activity": status_rank(F.col("status")).asc(),
        "readers": F.size("readers").desc(),
        "merit": F.desc_nulls_last("merit"),
        "year": F.coalesce("year", F.lit(0)).desc(),
        "title": F.collate(F.coalesce("title", F.lit("")), "UNICODE").asc(),
    }
    return [first[mode], *newest] if mode in first else newest


def library_order(listing: DataFrame, mode: str) -> DataFrame:
    """listing in one of ORDERS; ties go by newest."""
    return listing.orderBy(*_order(mode))


def library_places(listing: DataFrame, modes: tuple[str, ...] = ORDERS) -> DataFrame:
    """(mode, id, place): each paper's place, from 1, in each of the orders. Rows are numbered in ranges, without a global window;
    what an order goes by is worked out before, so that lists of readers do not travel."""
    slim = kept(listing.select("id", "created_at", "status", F.transform("readers", lambda r: F.lit(1)).alias("readers"), "merit", "year", "title"), "listing")
    out = None
    for mode in modes:
        placed = running_totals(slim, _order(mode), scratch(listing.sparkSession, mode), {"place": None})
        rows = placed.select(F.lit(mode).alias("mode"), "id", (F.col("place") + 1).alias("place"))
        out = rows if out is None else out.union(rows)
    return out


def shelf_order(rows: DataFrame, is_own: bool) -> DataFrame:
    """One's own shelf newest first, with each month's first row marked; others' by seminar rank, then newest."""
    if not is_own:
        return rows.orderBy(*_order("activity"))
    month = F.date_format("created_at", "MMMM yyyy")
    w = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("month", month).withColumn("starts_month", ~F.col("month").eqNullSafe(F.lag("month").over(w))).orderBy("user_id", F.desc("created_at"), F.desc("id"))


def paper_detail(viewers: DataFrame, papers: DataFrame, copies: DataFrame, comments: DataFrame, rooms: DataFrame, editions: DataFrame) -> DataFrame:
    """Per (viewer, paper): own words, ratings, notes and edition, others who display it, rooms newest first, what one may see.

    viewers: user_id, paper_id; comments: with created_at, and content if it is to be shown. Notes are the holder's own, by (created_at, id); the edition is
    the pinned one, else the latest. Every fact
    table is aggregated by its key before it is joined. What all viewers of a paper share is in paper_page, so that no
    list of readers is repeated for each viewer.
    """
    said = [c for c in ("summary", *OPINIONS) if c in copies.columns]
    latest = latest_edition(editions.select("paper_id", "id")).withColumnRenamed("edition_id", "latest")
    own = copies.select("paper_id", "user_id", "marketed", "is_author", F.col("edition_id").alias("pinned"), "ignored_edition_id", *said)
    note = F.struct(*(c for c in ("created_at", "id", "content") if c in comments.columns))
    notes = comments.groupBy("paper_id", "user_id").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    shown = displayed_copies(copies).groupBy("paper_id").agg(F.count("*").alias("n_displayed"))
    own_rooms = rooms.groupBy("paper_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id")), asc=False), lambda r: r["id"]).alias("rooms"))
    # What a viewer has goes by (paper_id, user_id); what a paper has is put together by itself and meets the viewers once.
    page = papers.select(F.col("id").alias("paper_id"), "paper_key", "title").join(own_rooms, "paper_key", "left").drop("paper_key")
    out = viewers.join(own, ["paper_id", "user_id"], "left").join(notes, ["paper_id", "user_id"], "left")
    out = out.join(page, "paper_id").join(shown, "paper_id", "left").join(latest, "paper_id", "left")
    held = F.col("marketed").isNotNull()
    flags = [held.alias("holds"), F.coalesce("marketed", F.lit(False)).alias("is_reader")]
    kept = F.when(held, F.coalesce("notes", F.array().cast(notes.schema["notes"].dataType))).otherwise(F.array().cast(notes.schema["notes"].dataType))
    others = F.coalesce("n_displayed", F.lit(0)) - F.when(F.col("marketed"), 1).otherwise(0)
    return out.select("user_id", "paper_id", "title", "is_author", F.coalesce("pinned", "latest").alias("edition_id"), "ignored_edition_id", *said, *flags, kept.alias("notes"), others.alias("also_read_by"), F.coalesce("rooms", F.array().cast("array<bigint>")).alias("rooms"))


def paper_page(papers: DataFrame, copies: DataFrame, users: DataFrame, editions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per paper: editions by id, the latest one, all who display it, and its rooms' summaries, newest first.

    summaries: rooms as room_summary gives them.
    """
    files = editions.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("id", "sha256"))).alias("editions"), F.max("id").alias("latest_edition"))
    own = summaries.groupBy("paper_key").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "status", "creator", "leader", "n_members")), asc=False).alias("rooms"))
    # Rooms meet papers by key before the lists do, which then go by paper_id alone.
    out = papers.withColumnRenamed("id", "paper_id").join(own, "paper_key", "left").join(files, "paper_id", "left").join(readers_of(copies, users), "paper_id", "left")
    for c, part in (("editions", files), ("readers", out), ("rooms", own)):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(part.schema[c].dataType)))
    return out


def add_to_shelf(copies: DataFrame, requests: DataFrame, papers: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new copies, rejected): visible papers go on the shelf, pinned to their latest edition; held ones are rejected."""
    visible = visible_papers(papers, copies).select(F.col("id").alias("paper_id"))
    asked = requests.dropDuplicates(["paper_id", "user_id"])
    fresh = asked.join(visible, "paper_id", "left_semi").join(copies.select("paper_id", "user_id"), ["paper_id", "user_id"], "left_anti")
    new = fresh.join(latest_edition(editions.select("paper_id", "id")), "paper_id", "left")
    return new, asked.join(fresh, ["paper_id", "user_id"], "left_anti")


def set_personal_fields(copies: DataFrame, edits: DataFrame, guarded: DataFrame) -> DataFrame:
    """copies after readers edit their own: only fields sent change; a member of an active seminar may not hide the paper.

    edits: paper_id, user_id, and for each field a pair sent_x, new_x. guarded: (paper_id, user_id) that may not hide.
    """
    fields = [c[4:] for c in edits.columns if c.startswith("new_")]
    rows = copies.join(edits, ["paper_id", "user_id"], "left").join(guarded.select("paper_id", "user_id", F.lit(True).alias("guarded")).distinct(), ["paper_id", "user_id"], "left")
    rejected = F.coalesce(F.col("guarded") & F.col("sent_marketed") & ~F.col("new_marketed") & F.col("marketed"), F.lit(False)) if "marketed" in fields else F.lit(False)
    new = {c: F.when(F.coalesce(F.col(f"sent_{c}"), F.lit(False)) & ~rejected, F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in copies.columns), rejected.alias("rejected"))


def set_metadata(papers: DataFrame, edits: DataFrame) -> DataFrame:
    """papers after edits of shared fields: only fields sent change, for everyone. edits: id, and sent_x, new_x."""
    fields = [c[4:] for c in edits.columns if c.startswith("new_")]
    rows = papers.join(edits, "id", "left")
    return rows.select(*(F.when(F.coalesce(F.col(f"sent_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in papers.columns))


def edit_profiles(users: DataFrame, edits: DataFrame) -> DataFrame:
    """users after profile edits (id, name, affiliation): a blank name rejects the edit, a blank affiliation is none."""
    blank = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) == 0
    rows = users.join(edits.select("id", F.col("name").alias("__name"), F.col("affiliation").alias("__aff"), F.lit(True).alias("__sent")), "id", "left")
    rejected = F.coalesce(F.col("__sent") & blank(F.col("__name")), F.lit(False))
    ok = F.coalesce(F.col("__sent"), F.lit(False)) & ~rejected
    new = {"display_name": F.when(ok, strip("__name")).otherwise(F.col("display_name")), "affiliation": F.when(ok, F.when(~blank(F.col("__aff")), strip("__aff"))).otherwise(F.col("affiliation"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in users.columns), rejected.alias("rejected"))
