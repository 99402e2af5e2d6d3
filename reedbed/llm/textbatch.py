"""Vectorised splitting and hashing of the texts of one Arrow batch (numpy inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240611)
_GRAM = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of a block

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept for the life of the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """Some consecutive documents of a batch: rows lo..hi, their bytes, and each document's start in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into runs of whole documents of about limit bytes; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, hash, and the bounds of each document's words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


@dataclass
class Blocks:
    """Byte spans as 8-byte blocks, the last one filled up with zeros: values, each span's first block, blocks and bytes."""

    value: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray

    @property
    def within(self) -> np.ndarray:
        """Each block's number in its span."""
        return np.arange(len(self.value)) - np.repeat(self.first, self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hashes: every block is mixed with its number before blocks are summed."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        number = self.within.astype(np.uint64)
        mixed = mix(mix(self.value, 3) + number * np.uint64(0x9E3779B97F4A7C15), 4)
        return mix(np.add.reduceat(mixed, self.first), 1) ^ mix(self.size.astype(np.uint64), 5)

    def equal(self, own: np.ndarray, other: Blocks, theirs: np.ndarray) -> np.ndarray:
        """Whether spans own[k] here and theirs[k] in other have the same bytes."""
        out = self.size[own] == other.size[theirs]
        at = np.flatnonzero(out)
        count = self.count[own[at]]
        total = np.cumsum(count)
        step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)
        differs = self.value[np.repeat(self.first[own[at]], count) + step] != other.value[np.repeat(other.first[theirs[at]], count) + step]
        out[np.repeat(at, count)[differs]] = False
        return out


def span_blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Blocks:
    size = (end - start).astype(np.int64)
    count = np.maximum(1, (size + 7) // 8)
    total = np.cumsum(count)
    first = total - count
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    value = window[np.arange(total[-1] if len(total) else 0) * 8 + np.repeat(start - 8 * first, count)]
    if len(total):
        value[total - 1] &= _TAIL[size - 8 * (count - 1)]
    return Blocks(value, first, count, size)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_blocks(data, start, end).hashes()


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes in a row, through one prefix sum: good for choosing places, not for telling bytes apart."""
    n = len(data)
    power, inverse = (np.full(n + 1, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    for x in (power, inverse):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_ROLL[data] * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1], 3)


def words(chunk: Chunk, lower: bool = True, hashed: bool = True) -> Words:
    """Maximal runs of bytes other than \\x20 and \\x09-\\x0D; A-Z lower-cased before hashing if asked."""
    data, offsets = chunk.data, chunk.offsets
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hashes(LOWER[data] if lower else data, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document in text order, and each document's bounds among them.

    A document with fewer than n words, but at least one, has its whole sequence as its one shingle.
    """
    count = np.diff(w.bounds)
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(len(w.bounds), np.int64)
    full = np.zeros(len(w.hash), np.uint64)
    for k in range(n):
        full[: max(0, len(full) - k)] += w.hash[k:] * _GRAM[k]
    each = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate([[0], np.cumsum(each)])
    take = np.arange(bounds[-1]) + np.repeat(w.bounds[:-1] - bounds[:-1], each)
    out = full[take]
    short = np.flatnonzero((count > 0) & (count < n))
    for d in short:
        s, e = w.bounds[d], w.bounds[d + 1]
        out[bounds[d]] = np.concatenate([w.hash[s:e] * _GRAM[: e - s], _GRAM[32 + e - s : 33 + e - s]]).sum(dtype=np.uint64)
    return mix(out, 2), bounds


def sorted_sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and distinct, with new bounds."""
    h = h.copy()
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[s:e].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return h[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def long_lists(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow array<bigint> of one list a document."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.ascontiguousarray(h).view(np.int64)))
