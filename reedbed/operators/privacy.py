"""Export and erasure of readers' data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, strip
from ..sources.shared import kept
from .seminars import successors

# What an erased account is called, and its address.
ERASED_NAME, ERASED_EMAIL = "A former reader", "deleted-{id}@erased.invalid"


def _array(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """(user_id, name): a table's rows of each user as an array in its own order."""
    return rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))


def export_bundle(user_ids: DataFrame, users: DataFrame, parts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """One nested row for each reader: profile, and an array from each part (rows with user_id, order, fields).

    Each table is cut to the asked readers and made arrays before the join, so that no two facts multiply.
    """
    out = users.join(user_ids.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "user_id")
    for name, (rows, order, fields) in parts.items():
        own = rows.join(user_ids.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi")
        out = out.join(_array(own, name, order, fields), "user_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def own_seminars(rooms: DataFrame, participants: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, created_at, id, status, started, leads, my_messages): each member's rooms with their own messages by (created_at, id)."""
    said = messages.groupBy("room_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "content"))).alias("my_messages"))
    member = participants.select("room_id", "user_id").distinct().join(said, ["room_id", "user_id"], "left")
    rows = member.join(rooms.withColumnRenamed("id", "room_id"), "room_id")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("user_id"), F.lit(False))
    words = F.coalesce("my_messages", F.array().cast(said.schema["my_messages"].dataType))
    return rows.select("user_id", "created_at", F.col("room_id").alias("id"), "status", is_("created_by").alias("started"), is_("leader_id").alias("leads"), words.alias("my_messages"))


def notes_markdown(notes: DataFrame) -> DataFrame:
    """(user_id, markdown): notes under their papers' titles, papers in order of their first note.

    notes: id, user_id, title, name, page, content, current_place. A heading is the name, else the page or that there is
    none; a mark without text says so.
    """
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise("not placed on the page")
    named = F.length(F.coalesce("name", F.lit(""))) > 0
    heading = F.concat(F.when(named, F.col("name")).otherwise(where), F.when(named & F.col("page").isNotNull(), F.concat(F.lit(" — "), where)).otherwise(""), F.when(F.col("current_place"), "  *(where I left off)*").otherwise(""))
    body = F.when(F.length(F.coalesce("content", F.lit(""))) > 0, F.col("content")).otherwise("*(a mark, with nothing written on it)*")
    text = F.concat(F.lit("### "), heading, F.lit("\n\n"), body, F.lit("\n"))
    rows = notes.withColumn("title", F.coalesce("title", F.lit("(paper since removed)"))).withColumn("text", text)
    sections = rows.groupBy("user_id", "title").agg(F.min("id").alias("first"), F.sort_array(F.collect_list(F.struct("id", "text"))).alias("own"))
    section = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("own", lambda x: x["text"]), "\n"))
    return sections.withColumn("section", section).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "section"))), lambda x: x["section"]), "\n").alias("markdown"))


class FileNames:
    """Names given in turn, with -2, -3 ... where a name is taken."""

    def __init__(self):
        self.taken, self.last = set(), {}

    def name(self, title: str | None, year: int | None) -> str:
        base = _slug(title) + (f"-{year}" if year else "")
        n = self.last.get(base, 1)  # all numbers below are taken
        name = base if n == 1 else f"{base}-{n}"
        while name in self.taken:
            n += 1
            name = f"{base}-{n}"
        self.last[base] = n
        self.taken.add(name)
        return f"{name}.pdf"


_slug = lru_cache(1 << 16)(slugify)


def named_files(rows: list[tuple[str, int | None]]) -> list[str]:
    """A file name for each (title, year) in order, with -2, -3 ... where the name is taken."""
    own = FileNames()
    return [own.name(title, year) for title, year in rows]


def export_file_names(copies: DataFrame) -> DataFrame:
    """(user_id, copy_id, file_name). copies: user_id, copy_id, title, year; a name depends on those before it.

    Users are dealt whole and sorted, so that a task names one user after another, without a call for each.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, own = None, FileNames()
        for batch in batches:
            names = []
            for u, title, year in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if u != user:
                    user, own = u, FileNames()
                names.append(own.name(title, None if year is None or year != year else int(year)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string())], ["user_id", "copy_id", "file_name"])

    rows = copies.select(F.col("user_id").cast("long").alias("user_id"), F.col("copy_id").cast("long").alias("copy_id"), "title", "year")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "copy_id").mapInArrow(name, "user_id long, copy_id long, file_name string")


def allowed_erasures(users: DataFrame, leaving: DataFrame) -> DataFrame:
    """leaving (id, confirm_email) with refused: another email than the account's, or no other admin would remain."""
    rows = leaving.join(users.select("id", "email", "is_admin", "is_deleted"), "id")
    staying = users.filter("is_admin and not is_deleted").join(leaving.select("id"), "id", "left_anti").agg(F.count("*").alias("admins"))
    rows = rows.crossJoin(F.broadcast(staying))  # one row
    return rows.select("id", (~F.lower(strip("confirm_email")).eqNullSafe(F.lower("email")) | (F.col("is_admin") & (F.col("admins") == 0))).alias("refused"))


def erase_readers(leaving: DataFrame, users: DataFrame, private: dict[str, DataFrame], rooms: DataFrame, participants: DataFrame, eligible: DataFrame, at: Column) -> dict[str, DataFrame]:
    """All tables after the readers in leaving (id) are gone at a time.

    private tables (notes, ink, copies, notifications, sessions, availabilities) lose their rows; the user's row is
    scrubbed; rooms they led go to a successor, or open again without leader. Messages and editions are not touched.
    leaving is joined as it is: Spark broadcasts it while it is small.
    """
    gone = leaving.select(F.col("id").alias("user_id")).distinct()
    out = {name: rows.join(gone, "user_id", "left_anti") for name, rows in private.items()}
    out["participants"] = participants.join(gone, "user_id", "left_anti")
    marked = users.join(leaving.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left")
    scrub = {
        "email": F.replace(F.lit(ERASED_EMAIL), F.lit("{id}"), F.col("id").cast("string")),
        "display_name": F.lit(ERASED_NAME),
        "affiliation": F.lit(None).cast("string"),
        "avatar_path": F.lit(None).cast("string"),
        "deleted_at": at,
        "email_public": F.lit(False),
        "is_admin": F.lit(False),
        "is_deleted": F.lit(True),
    }
    out["users"] = marked.select(*(F.when(F.col("__gone"), scrub[c]).otherwise(F.col(c)).alias(c) if c in scrub else F.col(c) for c in users.columns))
    heirs = successors(rooms, participants, eligible, gone)
    moved = rooms.join(heirs.select(F.col("room_id").alias("id"), "new_leader", F.lit(True).alias("__led")), "id", "left")
    led = F.col("__led").isNotNull()
    new = {"leader_id": F.when(led, F.col("new_leader")).otherwise(F.col("leader_id")), "status": F.when(led & F.col("new_leader").isNull(), "open").otherwise(F.col("status"))}
    out["rooms"] = moved.select(*(new.get(c, F.col(c)).alias(c) for c in rooms.columns))
    return out


def erasure_report(leaving: DataFrame, tables: dict[str, DataFrame], rooms: DataFrame, participants: DataFrame, eligible: DataFrame) -> DataFrame:
    """(user_id, one count for each table, left, handed_on, reopened): what erasing each reader takes away or moves.

    Who leaves is written once, as every table meets it, and Spark then knows whether it is small."""
    gone = kept(leaving.select(F.col("id").alias("user_id")).distinct(), "leaving")
    counts = [rows.join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, rows in tables.items()]
    counts.append(participants.join(gone, "user_id", "left_semi").groupBy("user_id").agg(F.countDistinct("room_id").alias("n")).withColumn("what", F.lit("left")))
    heirs = successors(rooms, participants, eligible, gone).withColumn("what", F.when(F.col("new_leader").isNull(), "reopened").otherwise("handed_on"))
    counts.append(heirs.groupBy(F.col("old_leader").alias("user_id"), "what").agg(F.count("*").alias("n")).select("user_id", "n", "what"))
    every = counts[0]
    for part in counts[1:]:
        every = every.unionByName(part)
    names = [*tables, "left", "handed_on", "reopened"]
    wide = every.groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names))
    return gone.join(wide, "user_id", "left").na.fill(0)
