"""Suffix-array de-duplication: longest-previous-factor arrays over the repeated parts of a corpus.

A byte is repeated if a string of min_len bytes that covers it also starts elsewhere. The suffixes that can start such a
string are found first, so that only they are sorted:

* Every string of min_len bytes has an anchor, the least hashed k-byte core among its first min_len - k + 1, which depends
  on its bytes alone. Two equal strings have equal anchors at the same distance, so suffixes are dealt by anchor.
* Only anchors whose core occurs twice go on, each with the text around it (all strings that have this anchor). Equal
  surroundings are one row. Anchors with very many different surroundings are dealt further, by distance from the
  anchor and the bytes that all strings at these distances share; surroundings that are equal when cut to these
  distances are one row again, and groups that stay large are settled by counts of whole strings.
* In a group, the suffixes at the anchors are sorted, forwards and backwards, with the longest common prefixes of
  neighbours. For each distance, suffixes whose neighbours agree on min_len bytes form runs of the suffix order; the
  previous and next smaller positions inside a run give each suffix its earlier match (longest previous factor, capped
  at min_len) and, with positions reversed, its later match. A run's first position has no earlier match and is kept if
  keep_first is set.

Texts of several rows that are equal as a whole are one text throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .textbatch import chunks, rolling_hashes

WIDE = 2_000  # different surroundings of one core in a group; more are dealt by distance too
STEP = 16  # distances dealt together
BUFFER = 6 << 20  # bytes of surroundings that a task sorts together


def _core(min_len: int) -> int:
    return max(4, min_len // 5)


def anchors(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, place, first start, last start) of each anchor of a chunk: starts first..last have this anchor."""
    k = _core(min_len)
    w, n = min_len - k + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none.astype(np.uint64), none, none, none
    h = rolling_hashes(data, k)
    low = np.uint64((1 << 32) - 1)  # places; the same in chunks of any size, so that equal strings break ties of hashes alike
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = len(key) - w + 1
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    size = np.diff(offsets)
    fine = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(size >= min_len)
    np.add.at(fine, offsets[long], 1)
    np.add.at(fine, offsets[long] + size[long] - min_len + 1, -1)
    s = np.flatnonzero(np.cumsum(fine)[:starts])
    if not len(s):
        return none.astype(np.uint64), none, none, none
    a = at[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
    return h[a[first]], a[first], s[first], s[last]


def _anchor_lists(rows: DataFrame, min_len: int) -> DataFrame:
    """(h, n_bytes, whole, cores, places, firsts, lasts) of each row's text; whole is the SHA-256 of all of it."""
    names = ["doc_id", "h", "whole", "n_bytes", "cores", "places", "firsts", "lasts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(3)):
                core, place, first, last = anchors(c.data, c.offsets, min_len)
                bounds = np.searchsorted(first, c.offsets)
                base = np.repeat(c.offsets[:-1], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (core.view(np.int64), place - base, first - base, last - base)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(c.lo, c.hi - c.lo) for k in range(3)), pa.array(np.diff(c.offsets)), *lists], names)

    return rows.select("doc_id", "h", F.sha2("text", 256).alias("whole"), "text").mapInArrow(run, "doc_id long, h string, whole string, n_bytes long, cores array<long>, places array<long>, firsts array<long>, lasts array<long>")


def _surroundings(texts: DataFrame, min_len: int) -> DataFrame:
    """(core, doc, h, first, left, n_starts, around): the bytes that hold every string with this anchor."""
    names = ["core", "doc", "h", "first", "left", "n_starts", "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, doc, text, wanted = (batch.column(k)[row].as_py() for k in range(4))
                raw = text.encode()
                for k in range(0, len(wanted), 4096):
                    part = wanted[k : k + 4096]
                    cols = [[x[i] for x in part] for i in ("core", "place", "first", "last")]
                    left = [p - f for p, f in zip(cols[1], cols[2], strict=True)]
                    starts = [t - f + 1 for t, f in zip(cols[3], cols[2], strict=True)]
                    around = [raw[f : t + min_len] for f, t in zip(cols[2], cols[3], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array([h] * len(part)), pa.array(cols[2], pa.int64()), pa.array(left, pa.int32()), pa.array(starts, pa.int32()), pa.array(around, pa.binary())], names)

    return texts.select("h", "doc", "text", "wanted").mapInArrow(run, "core long, doc long, h string, first long, left int, n_starts int, around binary")


def _bytes_of(texts: DataFrame, asked: DataFrame, min_len: int) -> DataFrame:
    """asked (h, core, key, left, n_starts, first, count) with doc and around: the bytes of each surrounding, cut from its text."""
    names = ["core", "key", "left", "n_starts", "first", "count", "doc", "around"]
    fields = names[:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_py().encode()
                lists = batch.column(2)[row].values
                for k in range(0, len(lists), 4096):
                    part = lists.slice(k, 4096)
                    first, starts = (part.field(f).to_pylist() for f in ("first", "n_starts"))
                    around = [raw[f : f + n - 1 + min_len] for f, n in zip(first, starts, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.field(f) for f in fields), pa.array([doc] * len(part), pa.int64()), pa.array(around, pa.binary())], names)

    lists = asked.groupBy("h").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return texts.select("h", "doc", "text").join(lists, "h").select("doc", "text", "asked").mapInArrow(run, "core long, key string, left int, n_starts int, first long, count long, doc long, around binary")


def _order(parts: list[bytes], group: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the parts within their groups, and the common prefix of each with the one before (-1 at a group's start)."""
    order = np.array(sorted(range(len(parts)), key=lambda i: (group[i], parts[i])), np.int64)
    grid = np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)[order]
    differ = np.ones((len(parts), width + 1), bool)
    differ[1:, :width] = grid[1:] != grid[:-1]
    common = differ.argmax(1)
    own = np.array(group)[order]
    common[0] = -1
    common[1:][own[1:] != own[:-1]] = -1
    return order, common


def previous_smaller(run: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry of the same run with a smaller position, else -1. Runs are contiguous."""
    out = np.arange(len(run)) - 1
    out[1:][run[1:] != run[:-1]] = -1
    while len(todo := np.flatnonzero((out >= 0) & (position[out] >= position))):
        out[todo] = out[out[todo]]
    return out


def earlier_match(run: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether the previous or the next smaller position inside its run exists: a longest previous factor of full length."""
    return (previous_smaller(run, position) >= 0) | (previous_smaller(run[::-1], position[::-1]) >= 0)[::-1]


def _matches(group: list[int], left: np.ndarray, starts: np.ndarray, around: list[bytes], position: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, has an earlier match) of each start of a surrounding whose string occurs in another row of its group."""
    right_order, right_common = _order([x[n:] for x, n in zip(around, left.tolist(), strict=True)], group, min_len)
    left_order, left_common = _order([x[:n][::-1] for x, n in zip(around, left.tolist(), strict=True)], group, int(left.max()) if len(left) else 0)
    least = left - starts + 1
    right_rank, left_rank = np.empty_like(right_order), np.empty_like(left_order)
    out = []
    for d in range(int(least.min()), int(left.max()) + 1):
        right_rank[right_order] = np.cumsum(right_common < min_len - d)
        left_rank[left_order] = np.cumsum(left_common < d)
        on = np.flatnonzero((least <= d) & (d <= left))
        key = right_rank[on] * (len(around) + 1) + left_rank[on]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = key[1:] == key[:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if twin.any():
            rows = on[by[twin]]
            out.append((rows, left[rows] - d, earlier_match(key[twin], position[rows])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of each row: (row, first, last)."""
    order = np.lexsort((starts, rows))
    r, s = rows[order], starts[order]
    cut = np.flatnonzero((r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    a, b = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(r)]]).astype(int) - 1
    return (r[a], s[a], s[b]) if len(r) else (r, s, s)


def _group_spans(rows: DataFrame, min_len: int, keep_first: bool) -> DataFrame:
    """(key, lo, hi) of each surrounding's starts that match another surrounding of its group; rows are sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            names = {g: k for k, g in enumerate(dict.fromkeys(x[0] for x in held))}
            order = sorted(range(len(held)), key=lambda i: (held[i][5], held[i][6]))
            position = np.empty(len(held), np.int64)
            position[order] = np.arange(len(held))
            got, at, earlier = _matches([names[x[0]] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held]), [x[4] for x in held], position, min_len)
            if keep_first:
                got, at = got[earlier], at[earlier]
            r, lo, hi = _spans(got, at)
            return pa.RecordBatch.from_arrays([pa.array([held[k][1] for k in r.tolist()], pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["key", "lo", "hi"])

        held, size = [], 0
        stream = (tuple(x.values()) for batch in batches for part in range(0, batch.num_rows, 2048) for x in batch.slice(part, 2048).to_pylist())
        for _, rows_ in groupby(stream, key=lambda x: x[0]):
            own = list(rows_)
            if len(own) > 1:
                held += own
                size += sum(len(x[4]) for x in own)
            if size > BUFFER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return rows.select("grp", "key", "left", "n_starts", "around", "doc", "first").mapInArrow(run, "key string, lo long, hi long")


def _dealt(groups: DataFrame) -> DataFrame:
    return groups.repartition("grp").sortWithinPartitions("grp")


def _cell_spans(wide: DataFrame, space: Workspace, min_len: int, keep_first: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(key, lo, hi) of the surroundings of cores that have more than WIDE, and the tables to drop once they are read.

    A slice holds the starts at distances d0 .. d0 + STEP - 1 of the anchor, and the bytes they all share name its group.
    Cut to a slice, most surroundings of a common passage are equal: they are one cell, which owners tie to their keys.
    Groups that still have more than WIDE cells are settled by counts of whole strings, a distance at a time.
    """
    cut = wide.select("*", F.explode(F.expr(f"sequence((left - n_starts + 1) div {STEP}, left div {STEP})")).alias("slice"))
    cut = cut.select("*", F.expr(f"greatest(left - slice * {STEP} - {STEP} + 1, 0)").alias("skip"), F.expr(f"least(left - slice * {STEP}, n_starts - 1)").alias("end"))
    shared = F.expr(f"substring(around, left - slice * {STEP} + 1, {min_len - STEP + 1})")
    fine = cut.select("core", "slice", F.md5(shared).alias("shared"), "key", F.expr("left - skip").alias("left"), F.expr("end - skip + 1").cast("int").alias("n_starts"), F.expr(f"substring(around, skip + 1, end - skip + {min_len})").alias("around"), "doc", (F.col("first") + F.col("skip")).alias("first"), F.col("skip").alias("shift"))
    fine = fine.select(F.concat_ws(":", "core", "slice", "shared").alias("grp"), F.md5(F.concat(F.concat_ws(":", "core", "left", "n_starts").cast("binary"), F.lit(b":"), F.col("around"))).alias("cell"), "key", "left", "n_starts", "around", "doc", "first", "shift")
    cells = fine.groupBy("cell").agg(F.first("grp").alias("grp"), F.first("left").alias("left"), F.first("n_starts").alias("n_starts"), F.min(F.struct("doc", "first")).alias("at"), F.count("*").alias("times"), F.first("around").alias("around"))
    cells = space.keep(cells.select("cell", "grp", "left", "n_starts", "around", "at.doc", "at.first", "times"), "cells")
    sized = cells.join(cells.groupBy("grp").count().filter("count > 1"), "grp")
    narrow = sized.filter(F.col("count") <= WIDE).select("grp", F.col("cell").alias("key"), "left", "n_starts", "around", "doc", "first")
    found = _group_spans(_dealt(narrow), min_len, keep_first)
    each = sized.filter(F.col("count") > WIDE).select("cell", "grp", "left", "around", "doc", "first", F.explode(F.expr("sequence(0, n_starts - 1)")).alias("lo"))
    each = each.select("cell", "lo", "doc", (F.col("first") + F.col("lo")).alias("first"), F.md5(F.concat(F.concat_ws(":", "grp", F.col("left") - F.col("lo")).cast("binary"), F.lit(b":"), F.expr(f"substring(around, lo + 1, {min_len})"))).alias("string"))
    each = space.keep(each, "strings")
    again = each.groupBy("string").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first")).alias("at")).filter("n > 1")
    hits = each.join(again, "string")
    if keep_first:
        hits = hits.filter("doc <> at.doc or first <> at.first")
    found = found.union(hits.select("cell", "lo", F.col("lo").alias("hi")))
    # All owners of a cell match whole, or all but the first, which has what its cell has.
    owners = fine.select("cell", "key", "shift", "doc", "first").join(cells.filter("times > 1").select("cell", F.col("doc").alias("d0"), F.col("first").alias("f0"), "n_starts"), "cell")
    single = fine.select("cell", "key", "shift", "doc", "first").join(cells.select("cell", F.col("doc").alias("d0"), F.col("first").alias("f0"), "times"), "cell")
    if keep_first:
        owners, single = owners.filter("doc <> d0 or first <> f0"), single.filter("doc = d0 and first = f0")
    else:
        single = single.filter("times = 1")
    own = single.join(found.withColumnRenamed("key", "cell"), "cell").select("key", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
    return own.union(owners.select("key", F.col("shift").cast("long").alias("lo"), (F.col("shift") + F.col("n_starts") - 1).cast("long").alias("hi"))), [cells, each]


def repeated_spans(docs: DataFrame, space: Workspace, min_len: int = 400, keep_first: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, spans) of docs (doc_id, text).

    rows: doc_id, h (the text's digest), n_bytes, whole. classes: h, copies, doc (least doc_id). spans: h, text and the
    starts (lo, hi) of repeated strings, for texts that have any.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.md5(F.col("text").cast("binary")))
    rows = space.keep(_anchor_lists(docs, min_len), "anchors")
    classes = rows.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"))
    lists = rows.filter("size(cores) > 0").select("h", "doc_id", "cores", "places", "firsts", "lasts").dropDuplicates(["h"])
    each = lists.select("h", F.explode(F.arrays_zip("cores", "places", "firsts", "lasts")).alias("x")).select("h", F.col("x.cores").alias("core"), F.col("x.places").alias("place"), F.col("x.firsts").alias("first"), F.col("x.lasts").alias("last"))
    twice = each.groupBy("core").count().filter("count > 1").select("core")
    wanted = each.join(twice, "core").groupBy("h").agg(F.collect_list(F.struct("core", "place", "first", "last")).alias("wanted"))
    wanted = wanted.join(classes, "h")
    texts = docs.join(wanted, "h").filter(F.col("doc_id").eqNullSafe(F.col("doc"))).select("h", "text", "wanted", F.coalesce("doc", F.lit(-1)).alias("doc")).dropDuplicates(["h"])
    texts = space.keep(texts, "texts")
    slim = space.keep(rows.select("doc_id", "h", "n_bytes", "whole"), "rows")
    classes = slim.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"))
    space.drop(rows)

    # What ties keys to places goes without bytes; they are cut again for the distinct surroundings that are to be compared.
    key = F.md5(F.concat(F.col("core").cast("string").cast("binary"), F.lit(b":"), F.col("left").cast("string").cast("binary"), F.lit(b":"), F.col("around")))
    places = space.keep(_surroundings(texts, min_len).select("core", "left", "h", "doc", "first", "n_starts", key.alias("key")), "places")
    once = places.groupBy("key").agg(F.first("core").alias("core"), F.first("left").alias("left"), F.first("n_starts").alias("n_starts"), F.min(F.struct("doc", "first", "h")).alias("at"), F.count("*").alias("times"))
    once = space.keep(once.select("key", "core", "left", "n_starts", "at.doc", "at.first", "at.h", "times"), "distinct")
    heads = once.select("key", "doc", "first", "times")
    many = once.groupBy("core").count()
    varied = space.keep(_bytes_of(texts, once.join(many.filter("count > 1"), "core"), min_len), "varied")
    plain = varied.filter(F.col("count") <= WIDE).select(F.col("core").cast("string").alias("grp"), "key", "left", "n_starts", "around", "doc", "first")
    wide, used = _cell_spans(varied.filter(F.col("count") > WIDE), space, min_len, keep_first)
    found = space.keep(_group_spans(_dealt(plain), min_len, keep_first).union(wide), "found")
    for table in (varied, *used):
        space.drop(table)
    # Equal surroundings match whole, all or all but the first.
    if keep_first:
        first = heads.filter("times > 1").select("key", F.col("doc").alias("d0"), F.col("first").alias("f0"))
        same = places.join(first, "key").filter("doc <> d0 or first <> f0")
        one = places.join(heads.select("key", F.col("doc").alias("d0"), F.col("first").alias("f0")), "key").filter("doc = d0 and first = f0")
    else:
        same = places.join(heads.filter("times > 1").select("key"), "key")
        one = places
    spans = one.select("key", "h", "first").join(found, "key").select("h", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    spans = spans.union(same.select("h", F.col("first").alias("lo"), (F.col("first") + F.col("n_starts") - 1).alias("hi")))
    spans = spans.groupBy("h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(texts.select("h", "text"), "h")
    return slim, classes, spans


def _cut(spans: DataFrame, min_len: int) -> DataFrame:
    """(h, n_removed, n_spans, kept_sha256, kept): the text without the union of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw, ends = row["text"].encode(), []
                for lo, hi in sorted((x["lo"], x["hi"] + min_len) for x in row["spans"]):
                    if ends and lo <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], hi)
                    else:
                        ends.append([lo, hi])
                kept, at = [], 0
                for lo, hi in ends:
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                out.append((row["h"], len(raw) - len(kept), len(ends), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["h", "n_removed", "n_spans", "kept_sha256", "kept"])

    return spans.select("h", "text", "spans").mapInArrow(run, "h string, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every byte in a repeated string goes, all of its places alike.

    One row per row of docs. Texts are UTF-8 bytes, null is empty; matches never cross documents and are judged on the
    input. Equal texts of min_len bytes or more go whole. Rows keep their id as it is, null or repeated. Other columns
    are ignored. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "suffix-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, spans = repeated_spans(docs, space, min_len, keep_first=False)
    cut = space.keep(_cut(spans, min_len).drop("kept"), "cut")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= min_len)
    return rows.join(classes.select("h", "copies"), "h").join(cut, "h", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def keep_first_copies(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept): each distinct text, under its least id, without the strings that have an earlier match.

    Earlier means at a smaller (doc_id, byte), null ids first; the first copy of every repeated string stays. Null is the empty
    text; rows that repeat a text are one; other columns are ignored; an empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "suffix-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, classes, spans = repeated_spans(docs, space, min_len, keep_first=True)
    cut = space.keep(_cut(spans, min_len), "cut")
    first = docs.withColumn("h", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).join(classes, "h").filter(F.col("doc_id").eqNullSafe(F.col("doc"))).dropDuplicates(["h"])
    return first.join(cut, "h", "left").select("doc_id", F.coalesce("kept", F.coalesce("text", F.lit("")).cast("binary")).alias("kept"))
