"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut into pieces, each distinct piece of a batch is encoded once by the library (which maps bytes to printable
characters), and ids are gathered back in text order. Decoding reverses the byte table: the bytes of all ids are joined
before they are read as UTF-8, so characters that tokens split come out whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import byte_bpe, encode_chunk
from .textbatch import chunks


def _packed(values: np.ndarray, bounds: np.ndarray, kind: str) -> pa.Array:
    """A binary column: each document's slice of values as little-endian bytes."""
    raw = np.ascontiguousarray(values.astype(kind))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, starts, ends]): every whole text's ids as packed little-endian unsigned 32-bit integers.

    starts and ends, packed alike, are each token's code points; a token that holds part of a character counts the whole
    character. Null is the empty text, which has no ids. Rows keep their id as it is, null or repeated. Other
    columns are ignored. An empty table gives an empty table.
    """

    names = ["doc_id", "n_tokens", "ids", *(["starts", "ends"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in byte_bpe(ranks_path)[1]], np.int64)
        for batch in batches:
            for c in chunks(batch.column(1)):
                ids, bounds, _, _ = encode_chunk(c, ranks_path)
                out = [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(bounds)), _packed(ids, bounds, "<u4")]
                if offsets:
                    lead = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                    end = np.cumsum(size[ids])
                    base = np.repeat(lead[c.offsets[:-1]], np.diff(bounds))
                    first = lead[np.minimum(end - size[ids] + 1, len(c.data))] - 1
                    out += [_packed(first - base, bounds, "<u4"), _packed(lead[end] - base, bounds, "<u4")]
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", starts binary, ends binary" * offsets)


def decode_ids(ids: np.ndarray, bounds: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, joined, and each document's bounds among them."""
    flat, begin, size = _byte_table(ranks_path)
    ids = ids.astype(np.int64)
    each = size[ids]
    total = np.concatenate([[0], np.cumsum(each)])
    take = np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], each)
    return flat[take], total[bounds]


@functools.cache
def _byte_table(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = byte_bpe(ranks_path)[1]
    size = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with a binary column decoded: the bytes of ids, joined. Null ids give null."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for c in chunks(batch.column(at)):
                whole.append(_packed(*decode_ids(np.ascontiguousarray(c.data).view("<u4"), c.offsets // 4, ranks_path), "u1"))
            out = pa.concat_arrays(whole) if whole else pa.array([], pa.binary())
            null = batch.column(at).is_null()
            if batch.column(at).null_count:
                out = pa.array([None if x else y.as_py() for x, y in zip(null.to_pylist(), out, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and its ids decoded, in one pass.

    Null is the empty text, which has no ids; ids of rows stay as they are, null or repeated; other columns are ignored;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                ids, bounds, _, _ = encode_chunk(c, ranks_path)
                raw, ends = decode_ids(ids, bounds, ranks_path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(np.diff(bounds)), _packed(ids, bounds, "<u4"), _packed(raw, ends, "u1")], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    both = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
