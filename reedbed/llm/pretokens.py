"""Vectorised pre-tokenisation for byte-level BPE, and encoding of each distinct piece once a batch."""

from __future__ import annotations

import base64
import functools
import itertools
import unicodedata
from collections.abc import Callable

import numpy as np

from .textbatch import LOWER, Blocks, Chunk, span_blocks

LETTER, NUMBER, WHITE, OTHER = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_PIECES = 1_000_000


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    return out


def piece_starts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces of a chunk, and each document's bounds among them.

    Pieces are the matches of the pattern that optional-space words, numbers and signs, contractions and white space make
    ('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+), found from class changes between
    neighbouring code points instead of a regular expression.
    """
    data, offsets = chunk.data, chunk.offsets
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _classes()[code]
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(lead, offsets)] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= doc
    # A run of white space before other text gives up its last character; a space then joins the next piece.
    white = kind == WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~doc[1:n])
    start[last] = True
    space = last[code[last] == 0x20]
    start[space + 1] = False
    # Contractions: an apostrophe that begins a piece, and the letters after it.
    quote = np.flatnonzero((code == 0x27) & start[:n])
    if len(quote):
        size = _contraction(np.concatenate([code, np.zeros(3, np.uint32)]), quote, doc, n)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
    at = np.flatnonzero(start[:n])
    byte = lead[at]
    return byte, np.searchsorted(byte, offsets)


def word_pieces(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(start, end, bounds) of letter runs, single numbers, sign runs and contractions, white space dropped.

    None where the cut cannot be made before the tokenizer normalises the text: beyond U+02FF, where normalisation can
    join characters, at U+0130, whose lower case is two of them, or where a special token's bracket stands.
    """
    data, offsets = chunk.data, chunk.offsets
    if len(data) and (data.max() >= 0xCC or any(x in data.tobytes() for x in (b"<|", b"\xc4\xb0"))):
        return None
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    code = data[lead].astype(np.uint32)
    two = np.flatnonzero(code >= 0xC0)
    code[two] = (code[two] & 0x1F) << 6 | data[lead[two] + 1] & 0x3F
    kind = _classes()[code]
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(lead, offsets)] = True
    start = doc.copy()
    start[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero((code == 0x27) & start[:n])
    if len(quote):
        low = np.concatenate([np.where((code >= 65) & (code <= 90), code + 32, code), np.zeros(3, np.uint32)])
        size = _contraction(low, quote, doc, n)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
    at = np.flatnonzero(start[:n])
    end = np.concatenate([at[1:], [n]])
    solid = kind[at] != WHITE
    at, end = at[solid], end[solid]
    edge = np.concatenate([lead, [len(data)]])
    return edge[at], edge[end], np.searchsorted(edge[at], offsets)


def _contraction(code: np.ndarray, quote: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Letters of the contraction after each apostrophe, 0 for none. code has three more places than text."""
    one, two = code[quote + 1], code[quote + 2]
    size = np.zeros(len(quote), np.int64)
    size[np.isin(one, [ord(c) for c in "stmd"])] = 1
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b)) & ~doc[np.minimum(quote + 2, n)]] = 2
    size[doc[quote + 1]] = 0
    return size


class PieceCache:
    """Ids of pieces by their 64-bit hash, in sorted arrays; encode is given the distinct unseen pieces of a chunk.

    Bytes decide: a piece whose bytes differ from those kept under its hash is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fold: bool = False):
        self.encode, self.fold = encode, fold
        self._clear()

    def _clear(self) -> None:
        self.known, self.place, self.size, self.span = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.held, self.blocks, self.spans = Blocks(np.zeros(1 << 16, np.uint64), *(np.zeros(1 << 16, np.int64) for _ in range(3))), 0, 0

    @staticmethod
    def _put(whole: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        """whole with new behind its used entries, in an array twice as long where it is full."""
        while used + len(new) > len(whole):
            whole = np.concatenate([whole, np.zeros_like(whole)])
        whole[used : used + len(new)] = new
        return whole

    def _add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Append ids of some pieces; returns where each piece's begin."""
        self.flat = self._put(self.flat, self.used, ids)
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return begin

    def _learn(self, fresh: np.ndarray, ids: np.ndarray, size: np.ndarray, own: Blocks) -> None:
        begin = self._add(ids, size)
        where = np.searchsorted(self.known, fresh)
        self.place = np.insert(self.place, where, begin)
        self.size = np.insert(self.size, where, size)
        self.span = np.insert(self.span, where, self.spans + np.arange(len(fresh)))
        self.known = np.insert(self.known, where, fresh)
        at = (self.blocks, self.spans, self.spans, self.spans)
        new = (own.value, own.first + self.blocks, own.count, own.size)
        kept = (self.held.value, self.held.first, self.held.count, self.held.size)
        self.held = Blocks(*(self._put(x, k, y) for x, k, y in zip(kept, at, new, strict=True)))
        self.blocks, self.spans = self.blocks + len(own.value), self.spans + len(own.first)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of ids of each piece."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = LOWER[data] if self.fold else data
        blocks = span_blocks(data, start, end)
        h, first, which = np.unique(blocks.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        raw = data.tobytes()
        read = lambda own: [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]
        if new.any():
            fresh = first[new]
            self._learn(h[new], *self.encode(read(fresh)), span_blocks(data, start[fresh], end[fresh]))
            at = np.searchsorted(self.known, h)
        begin, each = self.place[at][which], self.size[at][which]
        odd = np.flatnonzero(~blocks.equal(np.arange(len(start)), self.held, self.span[at][which]))
        if len(odd):
            ids, size = self.encode(read(odd))
            begin[odd], each[odd] = self._add(ids, size), size
        total = np.cumsum(each)
        return self.flat[np.arange(total[-1]) + np.repeat(begin - (total - each), each)], each


def encode_each(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and their number for each piece."""
    got = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
    size = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _parts(ranks: dict[bytes, int], token: bytes, rank: int) -> list[bytes]:
    """The two parts whose merge made the token: what merging by lower ranks alone leaves."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] >= rank:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


@functools.cache
def byte_bpe(path: str):
    """(tokenizer, table of each id's bytes) of the tokenizers library, built from a file of ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    char = byte_characters()
    name = {t: "".join(char[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(p := _parts(ranks, token, rank)) == 2:
            merges.append((name[p[0]], name[p[1]]))
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    return out, table


@functools.cache
def byte_bpe_cache(path: str) -> PieceCache:
    tokenizer, _ = byte_bpe(path)
    return PieceCache(lambda pieces: encode_each(tokenizer, pieces))


def encode_chunk(chunk: Chunk, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, each document's bounds among them, ids of each piece, piece bounds of each document)."""
    start, bounds = piece_starts(chunk)
    end = np.concatenate([start[1:], [len(chunk.data)]]) if len(start) else start
    ids, each = byte_bpe_cache(path).ids(chunk.data, start, end)
    return ids, np.concatenate([[0], np.cumsum(each)])[bounds], each, bounds
