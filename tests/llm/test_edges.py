"""Texts above the size of a chunk, batches that are cut at one, empty tables, repeated rows, nulls and clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from reedbed.llm import suffix_dedup
from reedbed.llm.byte_bpe import decode, encode, encode_digests
from reedbed.llm.decontam import contaminated, drop_contaminated
from reedbed.llm.ngram_join import ngram_components
from reedbed.llm.pretokens import read_ranks
from reedbed.llm.rans import token_file_digests
from reedbed.llm.textbatch import CHUNK_BYTES
from reedbed.llm.token_counts import edit_trees, edited_counts, made_edits, token_trees

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mé", "ri") for b in ("s", "nt", "r") for c in ("a", "e", "i", "ou", "ung")]


def long_texts():
    """Two near copies of more than a chunk, a text of a chunk and a byte, and small ones before, between and after."""
    draw = np.random.default_rng(3)
    text = lambda n: " ".join(np.array(WORDS)[draw.integers(0, len(WORDS), n)])
    big = text(CHUNK_BYTES // 4)
    other = text(CHUNK_BYTES // 3)
    other = other.encode()[: CHUNK_BYTES + 1].decode(errors="ignore")
    return [(1, "one two three four five"), (2, big), (3, ""), (4, "changed start " + big[1000:] + " changed end"), (5, None), (6, other), (7, "one two three four five"), (8, text(300))]


@pytest.fixture(scope="module")
def rows():
    out = long_texts()
    assert sum(len((t or "").encode()) > CHUNK_BYTES for _, t in out) == 3
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, tokens string, n int").coalesce(1).cache()


def test_near_copies_above_a_chunk(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_components(docs, n=4, percent=85).collect()}
    for i, t in rows:
        w = (t or "").split()
        assert got[i][0] == (len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if len(w) >= 4 else bool(w))
    assert {i: g[1:] for i, g in got.items()} == {1: (1, 1), 2: (2, 1), 3: (3, 0), 4: (2, 1), 5: (5, 0), 6: (6, 0), 7: (1, 1), 8: (8, 0)}


def test_items_in_texts_above_a_chunk(spark, docs, rows):
    item = " ".join(rows[1][1].split()[90_000:90_040])
    bench = spark.createDataFrame([(70, item, 1), (70, item, 1), (None, "one two three four five", 1), (71, None, 1), (72, "", 1)], "item_id long, text string, doc_id int")
    twice = docs.union(docs.filter("doc_id = 2"))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(twice, bench).collect()}
    assert got == {(2, 70, 0), (4, 70, 0)}
    nameless = spark.createDataFrame([(None, f"see {item} there"), (None, "clean words"), (None, None), (9, "clean")], "doc_id long, text string")
    assert sorted((r["text"] or "") for r in drop_contaminated(nameless, bench).collect()) == ["", "clean", "clean words"]
    assert drop_contaminated(docs, bench).count() == 6 and contaminated(docs.limit(0), bench).count() == 0


def test_repeats_in_texts_above_a_chunk(docs, rows):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 400).collect()}
    a, b = rows[1][1].encode(), rows[3][1].encode()
    cut, more = len(rows[1][1][:1000].encode()), 0
    while a[cut - more - 1] == b[13 - more]:
        more += 1
    kept = {2: a[: cut - more], 4: b[: 14 - more] + b" changed end"}
    for i, k in kept.items():
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(a) - cut + more, 1, hashlib.sha256(k).hexdigest())
    assert all(got[i]["n_removed"] == 0 and got[i]["kept_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i not in kept)


def test_anchors_of_equal_strings_in_chunks_of_any_size(monkeypatch):
    hashes = suffix_dedup.rolling_hashes
    monkeypatch.setattr(suffix_dedup, "rolling_hashes", lambda data, k: hashes(data, k) & np.uint64(3 << 40 | 4095))
    draw = np.random.default_rng(5)
    letters = lambda n: draw.integers(97, 123, n, dtype=np.uint8)

    def anchor(data, at):
        _, place, first, _ = suffix_dedup.anchors(data, np.array([0, len(data)]), 40)
        return place[np.searchsorted(first, at, "right") - 1] - at

    for _ in range(20):
        text = letters(40)
        assert anchor(text, 0) == anchor(np.concatenate([letters(5000), text, letters(3000)]), 5000)


def test_tokens_of_texts_above_a_chunk(docs, rows):
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})
    got = {r["doc_id"]: r for r in encode_digests(docs, BYTE_BPE).collect()}
    word, start = Tokenizer.from_file(WORD_BPE), 0
    files = {r["doc_id"]: tuple(r)[1:] for r in token_file_digests(docs, WORD_BPE).collect()}
    counts = {r["doc_id"]: r for r in edited_counts(made_edits(docs), BYTE_BPE).collect()}
    for i, t in rows:
        ids = bpe.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and counts[i]["n_tokens"] == len(ids)
        own = word.encode(t or "", add_special_tokens=False).ids + [1]
        assert files[i] == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert encode(none, BYTE_BPE).count() == decode(encode(none, BYTE_BPE), BYTE_BPE).count() == 0
    trees = token_trees(none, BYTE_BPE)
    assert trees.count() == 0 and edit_trees(trees.join(made_edits(none).select("doc_id", "edits"), "doc_id"), BYTE_BPE).count() == 0
    assert suffix_dedup.keep_first_copies(none).count() == suffix_dedup.remove_repeats(none).count() == 0
    assert ngram_components(none).count() == token_file_digests(none, WORD_BPE).count() == 0


def test_first_copies_with_nulls_and_repeats(spark):
    shared = "".join(np.random.default_rng(6).choice(list("abcdefgh"), 80))
    rows = [(2, "cc" + shared), (1, "aa" + shared), (1, "aa" + shared), (3, None), (4, ""), (None, "n" + shared)]
    got = suffix_dedup.keep_first_copies(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"), 50).collect()
    assert sum(bytes(r["kept"]).decode().count(shared) for r in got) == 1
    assert len(got) == 4
