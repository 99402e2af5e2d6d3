"""Edit-aware token counts: segment trees of pre-tokens, re-encoding only what edits touch.

A document's pre-tokens are dealt into leaves of LEAF each, under a tree of (bytes, code points, tokens) sums. An edit finds
its leaves by descending code-point sums; they are cut and encoded again with a leaf of context on either side (more, while
the context's own pre-tokens do not come out as they were), and the sums above them are updated. The edits of the documents
of a chunk are taken in turns, so that the regions of one turn are encoded together. Trees can be stored: token_trees gives
the pre-tokens as columns, and edit_trees applies a later batch of edits to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import byte_bpe_cache, piece_starts
from .textbatch import Chunk, chunks

LEAF = 32


class Pieces:
    """Pre-tokens of some bytes: running totals of bytes, code points and tokens."""

    def __init__(self, raw: bytes, cuts: np.ndarray, chars: np.ndarray, tokens: np.ndarray):
        self.raw, self.cuts, self.chars, self.tokens = raw, cuts, chars, tokens

    def part(self, a: int, b: int) -> Pieces:
        return Pieces(self.raw, self.cuts[a : b + 1], self.chars[a : b + 1], self.tokens[a : b + 1])


def _totals(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


def _cut(chunk: Chunk, ranks_path: str, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[Pieces, np.ndarray]:
    """All pre-tokens of a chunk, and each document's bounds among them. known: their starts, tokens and bounds."""
    if known:
        start, each, bounds = known
    else:
        start, bounds = piece_starts(chunk)
        each = byte_bpe_cache(ranks_path).ids(chunk.data, start, np.append(start[1:], len(chunk.data)))[1] if len(start) else start
    cuts = np.append(start, len(chunk.data))
    return Pieces(chunk.data.tobytes(), cuts, _totals((chunk.data & 0xC0) != 0x80)[cuts], _totals(each)), bounds


class TokenTree:
    """Pre-token segment tree of one document."""

    def __init__(self, pieces: Pieces):
        self.encoded = 0
        self.leaves: list[tuple[Pieces, int, int]] = self._dealt(pieces, [*range(0, len(pieces.cuts) - 1, LEAF), len(pieces.cuts) - 1])
        self._build()

    @staticmethod
    def _dealt(pieces: Pieces, bounds: list[int]) -> list[tuple[Pieces, int, int]]:
        return [(pieces, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def _sums_of(self, leaf: tuple[Pieces, int, int]) -> tuple[int, int, int]:
        p, a, b = leaf
        return int(p.cuts[b] - p.cuts[a]), int(p.chars[b] - p.chars[a]), int(p.tokens[b] - p.tokens[a])

    def _build(self) -> None:
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = [(0, 0, 0)] * self.width + [self._sums_of(x) for x in self.leaves]
        self.sums += [(0, 0, 0)] * (2 * self.width - len(self.sums))
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        (a, b, c), (x, y, z) = self.sums[2 * k], self.sums[2 * k + 1]
        self.sums[k] = (a + x, b + y, c + z)

    def total(self) -> int:
        return self.sums[1][2]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, code points before the place in it); the document's end is in its last leaf."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.sums[k][1] and self.sums[k + 1][1]:
                at -= self.sums[k][1]
                k += 1
        return k - self.width, at

    def _raw(self, k: int) -> bytes:
        p, a, b = self.leaves[k]
        return p.raw[p.cuts[a] : p.cuts[b]]

    def _bytes(self, k: int, chars: int) -> int:
        """Bytes of the first code points of a leaf."""
        size, all_, _ = self.sums[self.width + k]
        return chars if size == all_ else len(self._raw(k).decode()[:chars].encode())

    def region(self, start: int, length: int, text: bytes, back: int, ahead: int) -> tuple[int, int, bytes]:
        """(lo, hi, bytes): the leaves that are encoded again for an edit, with context, and their bytes after it.

        The edit replaces length code points from start by text; the range is cut to the document.
        """
        if not self.leaves:
            return 0, 0, text
        end = self.sums[1][1]
        start = min(max(0, start), end)
        first, a = self._find(start)
        last, b = self._find(min(start + max(0, length), end))
        lo, hi = max(0, first - back), min(len(self.leaves), last + 1 + ahead)
        before = b"".join([*map(self._raw, range(lo, first)), self._raw(first)[: self._bytes(first, a)]])
        after = b"".join([self._raw(last)[self._bytes(last, b) :], *map(self._raw, range(last + 1, hi))])
        return lo, hi, before + text + after

    def unlike(self, lo: int, hi: int, new: Pieces) -> tuple[bool, bool]:
        """Whether the context at the start and at the end of a region did not come out as it was.

        Context is the region's first and last leaf, unless the document begins or ends there. Four pre-tokens at least must
        be alike.
        """
        size = np.diff(new.cuts)

        def differs(k: int, tail: bool) -> bool:
            p, a, b = self.leaves[k]
            old = np.diff(p.cuts[a : b + 1])
            return len(old) < 4 or len(old) > len(size) or not np.array_equal(old, size[len(size) - len(old) :] if tail else size[: len(old)])

        return lo > 0 and differs(lo, False), hi < len(self.leaves) and differs(hi - 1, True)

    def replace(self, lo: int, hi: int, new: Pieces) -> None:
        """Put encoded pre-tokens in the place of leaves, and update the sums above them."""
        n, size = hi - lo, len(new.cuts) - 1
        self.encoded += size
        if n and 4 * n <= size <= 2 * LEAF * n:
            bounds = [size * k // n for k in range(n + 1)]
        else:  # the number of leaves changes
            bounds = [*range(0, size, LEAF), size]
        leaves = self._dealt(new, bounds)
        self.leaves[lo:hi] = leaves
        if len(leaves) != n:
            self._build()
            return
        for k in range(lo, hi):
            self.sums[self.width + k] = self._sums_of(self.leaves[k])
        a, b = (self.width + lo) // 2, (self.width + hi - 1) // 2
        while a:
            for k in range(a, b + 1):
                self._add(k)
            a, b = a // 2, b // 2

    def stored(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(text, sizes, tokens) of all pre-tokens."""
        none = [np.zeros(0, np.int64)]
        return b"".join(map(self._raw, range(len(self.leaves)))), *(np.concatenate(none + [np.diff(getattr(p, k)[a : b + 1]) for p, a, b in self.leaves]) for k in ("cuts", "tokens"))


def _turn(trees: list[TokenTree], edits: list[dict], ranks_path: str) -> None:
    """One edit of each tree."""
    todo = [(k, 1, 1) for k in range(len(trees))]
    while todo:
        found = [trees[k].region(e["start"] or 0, e["length"] or 0, (e["text"] or "").encode(), back, ahead) for k, back, ahead in todo for e in (edits[k],)]
        offsets = _totals([len(x[2]) for x in found])
        pieces, bounds = _cut(Chunk(0, len(found), np.frombuffer(b"".join(x[2] for x in found), np.uint8), offsets), ranks_path)
        again = []
        for (k, back, ahead), (lo, hi, _), a, b in zip(todo, found, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            new = pieces.part(a, b)
            head, tail = trees[k].unlike(lo, hi, new)
            if head or tail:
                again.append((k, back + head, ahead + tail))
            else:
                trees[k].replace(lo, hi, new)
        todo = again


def _edited(chunk: Chunk, edits: list, ranks_path: str, known=None) -> tuple[list[TokenTree], np.ndarray, np.ndarray]:
    """(trees after all edits, tokens and pre-tokens of each document before them)."""
    pieces, bounds = _cut(chunk, ranks_path, known)
    trees = [TokenTree(pieces.part(a, b)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for turn in range(max(map(len, edits), default=0)):
        some = [k for k, e in enumerate(edits) if len(e) > turn]
        _turn([trees[k] for k in some], [edits[k][turn] for k in some], ranks_path)
    return trees, np.diff(pieces.tokens[bounds]), np.diff(bounds)


def _edits_of(column: pa.Array, chunk: Chunk) -> list[list[dict]]:
    return [[e for e in x or [] if e is not None] for x in column.slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()]


def edited_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_encoded), one row per row of docs.

    docs: doc_id, text, edits (array of start, length, text; in code points of the text as the edits before have left
    it). n_encoded counts pre-tokens encoded again for the edits. Null text is empty; null edits are none; an edit beyond
    the end is cut to the text, a null text in an edit is empty. Repeated rows are counted apart; other columns are
    ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                edits = _edits_of(batch.column(2), c)
                trees, tokens, pieces = _edited(c, edits, ranks_path)
                cols = (tokens, [len(e) for e in edits], [t.total() for t in trees], pieces, [t.encoded for t in trees])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_encoded"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "edits").mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_pretokens long, n_encoded long")


def _tree_batch(ids: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    kept = [t.stored() for t in trees]
    cols = [pa.array([x[0].decode() for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.list_(pa.int32())), pa.array([x[2] for x in kept], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([ids, *cols, pa.array([t.total() for t in trees], pa.int64()), pa.array([t.encoded for t in trees], pa.int64())], ["doc_id", "text", "sizes", "tokens", "n_tokens", "n_encoded"])


TREE = "doc_id long, text string, sizes array<int>, tokens array<int>, n_tokens long, n_encoded long"


def token_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees to be stored: doc_id, text, the bytes and tokens of each pre-token, n_tokens, n_encoded (0).

    Null text is empty; rows keep their id, null or repeated; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                yield _tree_batch(batch.column(0).slice(c.lo, c.hi - c.lo), _edited(c, [[]] * (c.hi - c.lo), ranks_path)[0])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TREE)


def edit_trees(trees: DataFrame, ranks_path: str) -> DataFrame:
    """trees (columns of token_trees, and edits as in edited_counts) after their edits; pre-tokens that no edit touches are
    taken as stored. n_encoded counts those encoded for these edits. Null text is empty; other columns are ignored; an empty
    table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens = batch.column(2), batch.column(3)
            lists = sizes.offsets.to_numpy().astype(np.int64)
            size, each = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, tokens))
            for c in chunks(batch.column(1)):
                a, b = lists[c.lo], lists[c.hi]
                known = (_totals(size[a:b])[:-1], each[a:b], lists[c.lo : c.hi + 1] - a)
                yield _tree_batch(batch.column(0).slice(c.lo, c.hi - c.lo), _edited(c, _edits_of(batch.column(4), c), ranks_path, known)[0])

    return trees.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "sizes", "tokens", "edits").mapInArrow(run, TREE)


def made_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with edits made from its own columns: a cut and a replacement in the body, and an addition at the end."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text)
    edit = lambda start, length, new: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), new.alias("text"))
    edits = F.array(
        edit(F.floor(n / 3), 7, F.lit("")),
        edit(F.floor(n / 2), 3, F.concat(F.lit(" "), F.reverse(F.substring(text, 1, 12)), F.lit("'s "))),
        edit(n + 2, 0, F.concat(F.lit("\n"), F.substring(text, 20, 30))),
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), edits.alias("edits"))
