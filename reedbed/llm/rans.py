"""Token-ID output: static range asymmetric numeral system over independent interleaved blocks.

File format: a folder of Parquet files, `blocks`, whose rows are blocks of whole documents in ascending doc_id order,
beside `table`, the one frequency table that all blocks share. Inside a block, ids are cut into segments of
LANES * STEPS ids. Each segment has its own LANES coder states (its checkpoint), the place where its words begin and a
CRC-32 of the ids it decodes to, so any segment can be decoded alone and in parallel; numpy codes all lanes of all
segments of a block together. Spark writes and commits the files, so a lost executor only repeats its own blocks.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PieceCache, encode_each, word_pieces
from .store import Workspace
from .textbatch import chunks, words

LANES, STEPS = 32, 256
SCALE = 20  # frequencies of the shared table sum to 2 ** SCALE
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 18
END_ID = 1
BLOCK = "file int, first long, n_docs int, n_tokens long, doc_ids binary, lengths binary, states binary, places binary, checks binary, payload binary"


def frequency_table(count: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, at least 1 for each id that occurs."""
    count = count.astype(np.float64)
    out = np.where(count > 0, np.maximum(1, np.floor(count / max(1.0, count.sum()) * (1 << SCALE))), 0).astype(np.int64)
    left = (1 << SCALE) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if left >= 0:
        out[order[0]] += left
    for k in order:
        if left >= 0:
            break
        take = min(-left, int(out[k]) - 1)
        out[k] -= take
        left += take
    return out


class Coder:
    """Codes segments with one shared table."""

    def __init__(self, frequency: np.ndarray):
        self.f = frequency.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(frequency)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states of each segment's lanes, place of each segment's first word, words)."""
        n, per = len(ids), LANES * STEPS
        segments = -(-n // per)
        grid = np.zeros(segments * per, np.uint32)
        grid[:n] = ids
        grid = grid.reshape(segments, STEPS, LANES)
        live = (np.arange(segments * per) < n).reshape(segments, STEPS, LANES)
        state = np.full((segments, LANES), LOW)
        word = np.zeros(grid.shape, np.uint32)
        out = np.zeros(grid.shape, bool)
        for k in range(STEPS - 1, -1, -1):
            on = live[:, k]
            if not on.any():
                continue
            f = np.where(on, self.f[grid[:, k]], 1)
            full = on & (state >= f << np.uint64(63 - SCALE))
            word[:, k] = state.astype(np.uint32)
            out[:, k] = full
            state = np.where(full, state >> np.uint64(32), state)
            whole, rest = np.divmod(state, f)
            state = np.where(on, (whole << np.uint64(SCALE)) + rest + self.base[grid[:, k]], state)
        each = out.reshape(segments, per).sum(1)
        return state, np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.uint32) if segments else np.zeros(0, np.uint32), word[out]

    def decode(self, n: int, state: np.ndarray, place: np.ndarray, payload: np.ndarray) -> np.ndarray:
        """The n ids of the segments; all segments advance together."""
        segments, per = len(state), LANES * STEPS
        grid = np.zeros((segments, STEPS, LANES), np.uint32)
        live = (np.arange(segments * per) < n).reshape(segments, STEPS, LANES)
        at = place.astype(np.int64)
        state = state.copy()
        words_ = np.concatenate([payload, np.zeros(LANES, np.uint32)]).astype(np.uint64)
        for k in range(STEPS):
            on = live[:, k]
            if not on.any():
                break
            slot = state & np.uint64((1 << SCALE) - 1)
            got = self.symbol[slot]
            grid[:, k] = got
            state = np.where(on, self.f[got] * (state >> np.uint64(SCALE)) + slot - self.base[got], state)
            need = on & (state < LOW)
            nth = np.cumsum(need, axis=1)
            state = np.where(need, state << np.uint64(32) | words_[np.minimum(at[:, None] + nth - 1, len(words_) - 1)], state)
            at += nth[:, -1]
        return grid.reshape(-1)[:n]


@functools.cache
def _word_caches(path: str) -> tuple[PieceCache, PieceCache]:
    """Caches for pieces that are one word of the tokenizer each, and for any white-space-separated strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError(f"{path} has {tokenizer.get_vocab_size()} ids; the file format holds ids of 16 bits")
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text; ids that end a word tell where each ends."""
        texts = [" ".join(pieces[k : k + 2000]) for k in range(0, len(pieces), 2000)]
        ids, _ = encode_each(tokenizer, texts)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(pieces):
            return encode_each(tokenizer, pieces)
        return ids, np.diff(np.concatenate([[0], ends]))

    return PieceCache(joined, fold=True), PieceCache(lambda pieces: encode_each(tokenizer, pieces))


def encode_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): the tokenizers library's ids of every whole text, and END_ID, packed as unsigned 16-bit and squeezed.

    The tokenizer drops white space and merges within words only, so each distinct word, or white-space-separated string
    where words cannot be cut beforehand, is encoded once by the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                simple, any_ = _word_caches(tokenizer_path)
                pieces = word_pieces(c)
                if pieces is None:
                    w = words(c, hashed=False)
                    pieces, simple = (w.start, w.end, w.bounds), any_
                ids, each = simple.ids(c.data, *pieces[:2])
                bounds = np.concatenate([[0], np.cumsum(each)])[pieces[2]]
                ids = np.insert(ids, bounds[1:], END_ID).astype("<u2")
                bounds = bounds + np.arange(len(bounds))
                squeeze, ends = zstandard.ZstdCompressor(level=3), bounds.tolist()
                packed = pa.array([squeeze.compress(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), packed], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """Each document's ids."""
    widen = zstandard.ZstdDecompressor()
    return (np.frombuffer(widen.decompress(x.as_buffer()), "<u2") for x in column)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents; each task sends a row for each id it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                total += np.bincount(np.concatenate([*_unpacked(batch.column(0).slice(part, 256))]), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "count"])

    return tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def encode_blocks(ordered: DataFrame, frequency: bytes) -> DataFrame:
    """Blocks of the documents of each partition, which must be in doc_id order; file is the partition, first the tokens before the block in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = Coder(np.frombuffer(frequency, np.int64)), TaskContext.get().partitionId()
        ids, names, sizes, held, first = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            state, place, payload = coder.encode(flat)
            raw = flat.astype("<u4")
            checks = np.array([zlib.crc32(raw[k : k + LANES * STEPS].tobytes()) for k in range(0, len(raw), LANES * STEPS)], "<u4")
            row = [file, first, len(sizes), len(flat), np.array(names, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), state.astype("<u8").tobytes(), place.astype("<u4").tobytes(), checks.tobytes(), payload.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), strict=True):
                ids.append(own)
                names.append(name)
                sizes.append(len(own))
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield block()
                    first += held
                    ids, names, sizes, held = [], [], [], 0
        if sizes:
            yield block()

    return ordered.mapInArrow(run, BLOCK)


def decode_blocks(blocks: DataFrame, frequency: bytes) -> DataFrame:
    """(file, doc_id, at, ids): each document's ids as packed little-endian unsigned 32-bit integers; at is its first id's
    place in its file. Raises on a checksum that differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(frequency, np.int64))
        for batch in batches:
            for row in batch.to_pylist():
                state = np.frombuffer(row["states"], "<u8").reshape(-1, LANES).astype(np.uint64)
                raw = coder.decode(row["n_tokens"], state, np.frombuffer(row["places"], "<u4"), np.frombuffer(row["payload"], "<u4")).astype("<u4")
                for k, check in enumerate(np.frombuffer(row["checks"], "<u4").tolist()):
                    if zlib.crc32(raw[k * LANES * STEPS : (k + 1) * LANES * STEPS].tobytes()) != check:
                        raise ValueError(f"checksum of segment {k} of the block at {row['first']} of file {row['file']} differs")
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))])
                packed = pa.Array.from_buffers(pa.large_binary(), row["n_docs"], [None, pa.py_buffer(bounds * 4), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(row["n_docs"], row["file"], np.int32)), pa.array(np.frombuffer(row["doc_ids"], "<i8")), pa.array(bounds[:-1] + row["first"]), packed], ["file", "doc_id", "at", "ids"])

    return blocks.mapInArrow(run, "file int, doc_id long, at long, ids binary")


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, space: Workspace) -> None:
    """Encode docs (doc_id, text) and write the files of the format into folder, in ascending doc_id order."""
    tokens = space.keep(encode_ids(docs, tokenizer_path), "tokens")
    got = id_counts(tokens).toPandas()  # at most a row for each id of the vocabulary
    count = np.zeros(1 << 16, np.int64)
    count[got["id"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    table = frequency_table(count).astype(np.int64).tobytes()
    docs.sparkSession.createDataFrame([(table,)], "frequency binary").coalesce(1).write.parquet(f"{folder}/table")
    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    encode_blocks(ordered, table).write.parquet(f"{folder}/blocks")
    space.drop(tokens)


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, ids): start is the number of ids of all documents before it."""
    table = spark.read.parquet(f"{folder}/table").first()["frequency"]
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    before, total = {}, 0
    for row in blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect():  # a row for each file
        before[row["file"]] = total
        total += row["n"]
    starts = spark.createDataFrame([*before.items()], "file int, before long")
    rows = decode_blocks(blocks, bytes(table)).join(F.broadcast(starts), "file")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")


def token_file_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files written and read back.

    A null or empty text has END_ID alone. Rows with a null id are not written. Rows that repeat an id stand beside each
    other. Other columns are ignored. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "token-files")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    folder = space.path("files")
    write_ids(docs, tokenizer_path, folder, space)
    return read_ids(docs.sparkSession, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
