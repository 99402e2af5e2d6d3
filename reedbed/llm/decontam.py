"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK random walk maps a sequence to a longer one, so that few edits become a small Hamming distance: at step j it
writes the symbol it stands on and moves on or not by a random bit of (j, symbol). Symbols are words. Bit sampling takes a
few steps of the walk as a bucket key; the tables needed for the target recall follow from measured collisions of
items with the most edits that still count. Windows of items of lengths that miss it are all verified.

Windows are item-sized, at the places where a document shares a run of words with the item that every match within the
allowed edits must share (with e edits among L words, L - e words are left in e + 1 runs), so no match is passed over.
The items, not the documents, go to every task, in blocks of at most BLOCK_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import _GRAM, Words, chunks, mix, words

BLOCK_WORDS = 1 << 20
PERCENT = 80  # an item matches if at most 100 - PERCENT per cent of its words are edited
RECALL = 0.99
SAMPLED = 3  # steps that make a bucket key
WALKS, MOST_TABLES = 4, 96  # items whose recall these tables do not reach are verified without them
TRIALS = 64  # edited copies by which the recall of each length is measured
GATE = 1 << 20


def cgk_keys(symbols: np.ndarray, length: np.ndarray, tables: int) -> np.ndarray:
    """Bucket keys (rows, tables) of padded symbol rows; the walks and sampled steps are fixed by a seed and the length."""
    n, width = symbols.shape
    out = np.zeros((n, tables), np.uint64)
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    rows = np.arange(n)
    for walk in range(WALKS):
        rng = np.random.default_rng(7000 + walk)
        steps = rng.integers(0, 1 << 63, 3 * width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        own = range(walk, tables, WALKS)
        # Each table samples steps as fractions of 3 * length, so that items of every length are covered alike.
        sampled = {t: np.floor(rng.random(SAMPLED)[None, :] * 2 * length[:, None]).astype(np.int64) for t in own}
        weight = rng.integers(0, 1 << 63, (tables, SAMPLED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        written = np.zeros((n, 3 * width), np.uint64)
        at = np.zeros(n, np.int64)
        for j in range(3 * width):
            symbol = padded[rows, at]
            written[:, j] = symbol
            at = np.minimum(at + ((symbol * steps[j]) >> np.uint64(63)).astype(np.int64), np.minimum(length, width))
        for t, places in sampled.items():
            for k in range(SAMPLED):
                out[:, t] += mix(written[rows, places[:, k]] + np.uint64(k + 1)) * weight[t, k]
    return out


@dataclass
class Items:
    """A block of benchmark items: padded words, lengths, allowed edits, gram size, gate, LSH keys, and
    whether all windows are verified."""

    ids: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    edits: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    tables: int
    keys: np.ndarray
    exact: np.ndarray


def gram_size(length: int, edits: int) -> int:
    """Words of the item that must stand together in any match."""
    return max(1, -(-(length - edits) // (edits + 1)))


def _tables(symbols: np.ndarray, length: np.ndarray, edits: np.ndarray, recall: float) -> tuple[int, np.ndarray]:
    """(tables for the recall, items that miss it even so), from the collisions of items with copies that have all the
    edits they may have: TRIALS copies of items of each length."""
    rng = np.random.default_rng(11)
    exact = np.zeros(len(length), bool)
    lengths = np.unique(length[edits > 0])
    if not len(lengths):
        return WALKS, exact
    some = np.concatenate([np.resize(np.flatnonzero(length == n), TRIALS) for n in lengths])
    hits = []
    for lo in range(0, len(some), 1024):
        part = some[lo : lo + 1024]
        width = int((length[part] + edits[part]).max())
        pad, changed = np.zeros((len(part), width), np.uint64), np.zeros((len(part), width), np.uint64)
        for r, k in enumerate(part):
            row = list(symbols[k, : length[k]])
            pad[r, : len(row)] = row
            for place in sorted(rng.choice(len(row), int(edits[k]), replace=False), reverse=True):
                kind = rng.integers(3)
                row[place : place + (kind != 1)] = [] if kind == 0 else [rng.integers(1, 1 << 62, dtype=np.uint64)]
            row = row[: length[k]]
            changed[r, : len(row)] = row
        hits.append(cgk_keys(pad, length[part], MOST_TABLES) == cgk_keys(changed, length[part], MOST_TABLES))
    hit = np.concatenate(hits)
    found = lambda tables: hit[:, :tables].any(1).reshape(len(lengths), TRIALS).mean(1)
    tables = next((t for t in range(WALKS, MOST_TABLES, WALKS) if found(t).min() >= recall), MOST_TABLES)
    return tables, np.isin(length, lengths[found(tables) < recall])


def prepare(ids: list[int], texts: list[str], percent: int = PERCENT, recall: float = RECALL) -> Items | None:
    """Items of one block; those without words are left out."""
    lists, kept = [], []
    for c in chunks(pa.array(texts, pa.string())):
        w = words(c)
        for d in range(c.hi - c.lo):
            if w.bounds[d] < w.bounds[d + 1]:
                kept.append(ids[c.lo + d])
                lists.append(w.hash[w.bounds[d] : w.bounds[d + 1]])
    if not lists:
        return None
    length = np.array([len(x) for x in lists])
    edits = length * (100 - percent) // 100
    symbols = np.zeros((len(lists), int(length.max())), np.uint64)
    for k, x in enumerate(lists):
        symbols[k, : len(x)] = x
    by_size: dict[int, list] = {}
    for k, x in enumerate(lists):
        g = gram_size(len(x), int(edits[k]))
        h = _gram_hashes(x, g)
        by_size.setdefault(g, []).append((h, np.full(len(h), k), np.arange(len(h))))
    grams = {}
    for g, parts in by_size.items():
        h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        gate = np.zeros(GATE, bool)
        gate[(h & np.uint64(GATE - 1)).astype(np.int64)] = True
        grams[g] = (gate, h[order], item[order], place[order])
    tables, exact = _tables(symbols, length, edits, recall)
    return Items(np.array(kept, np.int64), symbols, length, edits, grams, tables, cgk_keys(symbols, length, tables), exact)


def _gram_hashes(h: np.ndarray, g: int) -> np.ndarray:
    if len(h) < g:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - g + 1, np.uint64)
    for k in range(g):
        out += h[k : len(h) - g + 1 + k] * _GRAM[k]
    return mix(out, 4)


def _windows(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, start) of windows whose document shares an item's run of words; starts may lie outside."""
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    out = []
    for g, (gate, h, item, place) in items.grams.items():
        own = _gram_hashes(w.hash, g)
        at = np.flatnonzero(gate[(own & np.uint64(GATE - 1)).astype(np.int64)])
        at = at[doc[at] == doc[at + g - 1]]
        lo, hi = np.searchsorted(h, own[at], side="left"), np.searchsorted(h, own[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if len(at):
            take = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            where = np.repeat(at, n)
            out.append(np.stack([doc[where], item[take], where - place[take]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def _gather(w: Words, doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Symbol rows from start, 0 outside the document."""
    at = start[:, None] + np.arange(width)[None, :]
    inside = (at >= w.bounds[doc][:, None]) & (at < w.bounds[doc + 1][:, None])
    return np.where(inside, w.hash[np.clip(at, 0, max(0, len(w.hash) - 1))], np.uint64(0))


def edit_distances(symbols: np.ndarray, length: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of each item row to any part of its region row, end of that part). Words are the units."""
    n, m = region.shape
    steps = np.arange(m + 1, dtype=np.int32)
    d = np.zeros((n, m + 1), np.int32)
    done = d.copy()
    for i in range(int(length.max()) if n else 0):
        miss = (region != symbols[:, i : i + 1]) | (region == 0)
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + miss)
        d = np.minimum.accumulate(new - steps, axis=1) + steps
        last = length == i + 1
        done[last] = d[last]
    return done.min(1), done.argmin(1)


def _matches(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, distance, end word) of verified windows."""
    doc, item, start = _windows(w, items)
    out = []
    for lo in range(0, len(doc), 4096):
        d, i, s = doc[lo : lo + 4096], item[lo : lo + 4096], start[lo : lo + 4096]
        length = items.length[i]
        width = int(length.max())
        rows = _gather(w, d, s, width)
        rows[np.arange(width)[None, :] >= length[:, None]] = 0
        same = (cgk_keys(np.pad(rows, ((0, 0), (0, items.symbols.shape[1] - width))), length, items.tables) == items.keys[i]).any(1) | items.exact[i]
        d, i, s, length = d[same], i[same], s[same], length[same]
        if len(d):
            most = int(items.edits[i].max())
            distance, end = edit_distances(items.symbols[i], length, _gather(w, d, s - 2 * most, width + 4 * most))
            good = distance <= items.edits[i]
            out.append((d[good], i[good], distance[good], (s - 2 * most + end - w.bounds[d])[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items a block at a time; the driver holds one block."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(f"{id_col} is not null and {text_col} is not null").distinct().toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].split())
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, n_words, end_word): items that a document contains, up to edited words.

    Words are runs outside \\x20 and \\x09-\\x0D, A-Z lower-cased. A row says that some run of the document's words is at
    most (100 - percent) per cent of the item's n_words edits away; distance is the least found, end_word where that run
    ends. Null or empty texts and items match nothing; repeated rows count once; a null doc_id is a value like others.
    Other columns are ignored. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, n_words int, end_word long"
    out = None
    for ids, texts in _blocks(benchmark, "item_id", "text"):
        items = prepare(ids, texts, percent, recall)
        if items is None:
            continue
        shared = spark.sparkContext.broadcast(items)  # at most BLOCK_WORDS words, whatever the number of documents

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for c in chunks(batch.column(1)):
                    d, i, distance, end = _matches(words(c), items)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d + c.lo)), pa.array(items.ids[i]), pa.array(distance.astype(np.int32)), pa.array(items.length[i].astype(np.int32)), pa.array(end.astype(np.int64))], ["doc_id", "item_id", "distance", "n_words", "end_word"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word", "n_words")).alias("x")).select("doc_id", "item_id", "x.distance", "x.n_words", "x.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without documents that contain an item; rows without an id are judged each by its text.

    Null and empty texts stay; rows that repeat an id go or stay together; all columns are kept as they are; an empty table,
    of documents or of items, drops nothing.
    """
    named = docs.join(contaminated(docs.filter("doc_id is not null"), benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    th = F.xxhash64("text")
    nameless = docs.filter("doc_id is null")
    found = contaminated(nameless.select(th.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__th")).distinct()
    return named.filter("doc_id is not null").union(nameless.join(found, th == F.col("__th"), "left_anti").select(*docs.columns))
