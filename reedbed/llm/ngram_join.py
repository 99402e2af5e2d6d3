"""N-gram Jaccard join: multiple-global-order prefix filtering, then exact verification.

Every document is its set of distinct word shingles (tokens). Two sets that reach the threshold share a token among the
first n - ceil(t n) + 1 tokens under ANY global order of tokens, so a pair must share a prefix token under each of several
orders. All orders put rare tokens first and permute tokens of like frequency differently.

Steps, all on Spark:
1. one pass gives each document's set size and set signature; equal sets are one class (from step 2 on a class goes by 64 bits
   of its signature: among 10^9 different sets two may share them with a probability of 3 %, and would be taken as one);
2. sets are thinned: a set of n tokens of which u occur in no other set can overlap no set by more than n - u, so it has
   no partner below the threshold. Tokens are looked at by quarters, each only for the sets that are left, so that most
   sets go before most of their tokens are shuffled;
3. tokens of the sets that are left are counted exactly; those of one set are dropped (they come first in every order);
4. under the first order, every prefix list has a hub, its set with the least share of dropped tokens; sets are grouped by
   hub, so that a set travels once for each hub instead of once for each of its prefix tokens;
5. inside a group, pairs that share prefix tokens under every order are verified on their whole sets. Each set leaves its
   group as one row: the least set that it is connected with there, and its number of links; a pair that meets in several
   groups is counted in the one with the smallest hub. Large groups are dealt into blocks, and block pairs are groups;
6. components come from a distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import Workspace
from .textbatch import chunks, grams, long_lists, mix, sorted_sets, words

ORDERS = 2
ROUNDS = ((0,), (1,), (2, 3))  # quarters of the tokens that each round of thinning looks at
BLOCK_ROWS, BLOCK_TOKENS = 1_000, 1 << 20  # of a block; a group is compared by pairs of blocks, so that no task holds more than two
CELLS = 1 << 21  # counts that a task adds up at once


def _signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    out = []
    for salt in (11, 12):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, salt), dtype=np.uint64)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return size, out[0], out[1]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for c in chunks(batch.column(1)):
        yield c.lo, c.hi, *sorted_sets(*grams(words(c), n))


def shingle_sets(docs: DataFrame, n: int, tokens: bool = True) -> DataFrame:
    """(doc_id, n, s1, s2[, tokens]): each document's set size, signature and set."""
    names = ["doc_id", "n", "s1", "s2", *(["tokens"] if tokens else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, bounds in _sets(batch, n):
                size, s1, s2 = _signatures(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(s1), pa.array(s2), *([long_lists(h, bounds)] if tokens else [])], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long" + ", tokens array<long>" * tokens)


def shared_counts(docs: DataFrame, n: int, quarters: tuple[int, ...]) -> DataFrame:
    """(s1, seen, shared): each set's number of tokens in the quarters, and of those that other sets hold too, at least.

    A token that two sets of one chunk hold is counted there, and only says so to the other chunks: a token that very many
    documents hold is one row a chunk. Repeated texts may be counted twice as shared, which thins less.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, bounds in _sets(batch, n):
                size, s1, _ = _signatures(h, bounds)
                owner = np.repeat(np.arange(len(size)), size)
                some = np.isin(h & np.uint64(3), np.array(quarters, np.uint64))
                token, owner = h[some].view(np.int64), owner[some]
                order = np.lexsort((s1[owner], token))
                token, owner = token[order], owner[order]
                fresh = np.ones(len(token), bool)
                fresh[1:] = (token[1:] != token[:-1]) | (s1[owner[1:]] != s1[owner[:-1]])
                token, owner = token[fresh], owner[fresh]
                first = np.ones(len(token), bool)
                first[1:] = token[1:] != token[:-1]
                several = ~(first & np.append(first[1:], True))
                mine, said = owner[several], token[several & first]
                docs_ = np.unique(owner)
                rows = [
                    (s1[docs_], s1[docs_], np.bincount(owner, minlength=len(size))[docs_], np.bincount(mine, minlength=len(size))[docs_]),
                    (token[~several], s1[owner[~several]], -np.ones(int((~several).sum()), np.int64), np.zeros(int((~several).sum()), np.int64)),
                    (said, np.zeros(len(said), np.int64), -2 * np.ones(len(said), np.int64), np.zeros(len(said), np.int64)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*rows, strict=True)], ["key", "s1", "seen", "shared"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            key, s1, seen, shared = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            whole = seen >= 0
            # Rows of a token in order: the note of another chunk (-2) first, then its sets.
            token, own, kind = (np.concatenate([a, b[~whole]]) for a, b in zip(held, (key, s1, seen), strict=True))
            out_s, out_n, out_k = [s1[whole]], [seen[whole]], [shared[whole]]
            if len(token):
                begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                size = np.diff(np.append(begin, len(token)))
                real = kind == -1
                low = np.minimum.reduceat(np.where(real, own, np.iinfo(np.int64).max), begin)
                high = np.maximum.reduceat(np.where(real, own, np.iinfo(np.int64).min), begin)
                both = (np.minimum.reduceat(kind, begin) == -2) | (low < high)
                good = np.repeat(both, size) & real
                good[1:] &= (own[1:] != own[:-1]) | (token[1:] != token[:-1]) | ~real[:-1]
                out_s.append(own[good])
                out_n.append(np.zeros(int(good.sum()), np.int64))
                out_k.append(np.ones(int(good.sum()), np.int64))
                held = (token[-1:], own[-1:], np.array([-2 if both[-1] else kind[-1]]))
            s, which = np.unique(np.concatenate(out_s), return_inverse=True)
            most = np.zeros(len(s), np.int64)
            np.maximum.at(most, which, np.concatenate(out_n))
            total = np.bincount(which, np.concatenate(out_k), len(s)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(most), pa.array(total)], ["s1", "seen", "shared"])

    rows = docs.select("doc_id", "text").mapInArrow(local, "key long, s1 long, seen long, shared long")
    rows = rows.repartition("key").sortWithinPartitions("key", "seen", "s1").mapInArrow(met, "s1 long, seen long, shared long")
    return rows.groupBy("s1").agg(F.max("seen").alias("seen"), F.sum("shared").alias("shared"))


def thinned_sets(docs: DataFrame, classes: DataFrame, n: int, percent: int, space: Workspace, orders: int = ORDERS) -> DataFrame:
    """(s1, rep, docs, n, left, tokens, p0, p1, ...): the sets that can have partners, without tokens of one set, and their
    prefix tokens under each order. left: share of the tokens that are left."""
    alive, texts = classes.withColumn("gone", F.lit(0).cast("long")), docs
    for k, quarters in enumerate(ROUNDS):
        found = shared_counts(texts, n, quarters)
        gone = F.col("gone") + F.greatest(F.coalesce(F.col("seen") - F.col("shared"), F.lit(0)), F.lit(0))
        left = alive.join(found, "s1", "left").withColumn("gone", gone).select(*alive.columns)
        left = space.keep(left.filter(F.col("n") * 100 - F.col("gone") * 100 >= F.col("n") * percent), "alive")
        fewer = space.keep(texts.join(left.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
        if k:
            space.drop(alive)
            space.drop(texts)
        alive, texts = left, fewer

    held = shingle_sets(texts, n).withColumnRenamed("doc_id", "rep").drop("n")
    held = space.keep(held.join(alive.select("rep", "s1").hint("shuffle_hash"), ["rep", "s1"], "left_semi").dropDuplicates(["s1"]), "sets")
    space.drop(texts)
    tokens = held.select("s1", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").count().filter("count > 1")
    ranked = tokens.join(counts, "token").groupBy("s1").agg(F.collect_list(F.struct("token", F.floor(F.log2("count")).cast("long").alias("level"))).alias("ranked"))
    ranked = ranked.join(alive.drop("gone"), "s1").filter(F.size("ranked") * 100 >= F.col("n") * percent)
    names = ["s1", "rep", "docs", "n", "left", "tokens", *(f"p{o}" for o in range(orders))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            token, level = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            size, n_ = np.diff(offsets), batch.column(3).to_numpy(zero_copy_only=False)
            keep = size - -(-percent * n_ // 100) + 1
            outs = []
            for o in range(orders):
                key = (level.astype(np.uint64) << np.uint64(58)) | (mix(token.view(np.uint64), 100 + o) >> np.uint64(6))
                parts = [token[s + np.argsort(key[s:e])[:p]] for s, e, p in zip(offsets[:-1], offsets[1:], keep, strict=True)]
                outs.append(long_lists(np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(size / n_), pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(token[offsets[0] : offsets[-1]])), *outs], names)

    kinds = "s1 long, rep long, docs long, n long, left double, tokens array<long>" + "".join(f", p{o} array<long>" for o in range(orders))
    out = space.keep(ranked.select("s1", "rep", "docs", "n", "ranked").mapInArrow(run, kinds), "prefixes")
    space.drop(held)
    space.drop(alive)
    return out


def hub_groups(sets: DataFrame, space: Workspace, orders: int = ORDERS) -> DataFrame:
    """(hub, b1, b2, own, hubs, and the columns of sets): sets by the hubs of their prefix lists under the first order.

    A set that shares no prefix token with another under one of the orders is dropped. Pairs of blocks of a group are
    groups of their own, b1 <= b2; own is the row's block. hubs are all hubs of the set.
    """
    posts = sets.select("s1", "left", *(f"p{o}" for o in range(orders)))
    for o in range(orders - 1, 0, -1):
        one = posts.select("s1", F.explode(f"p{o}").alias("token"))
        lists = one.groupBy("token").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).filter("low < high")
        posts = posts.join(one.join(lists, "token", "left_semi").select("s1").distinct(), "s1", "left_semi")
    one = posts.select("s1", "left", F.explode("p0").alias("token"))
    lists = one.groupBy("token").agg(F.min(F.struct(-F.col("left"), "s1")).getField("s1").alias("hub"), F.count("*").alias("count")).filter("count > 1")
    members = space.keep(one.join(lists, "token").select("hub", "s1").distinct(), "members")
    size = members.join(sets.select("s1", F.size("tokens").alias("m")), "s1").groupBy("hub").agg(F.expr(f"cast(ceil(greatest(count(*) / {BLOCK_ROWS}, sum(m) / {BLOCK_TOKENS})) as int)").alias("blocks"))
    hubs = members.groupBy("s1").agg(F.collect_list("hub").alias("hubs"))
    rows = members.join(size, "hub").withColumn("own", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))
    rows = rows.select("hub", "s1", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("hub", "s1", "own", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"))
    return rows.join(sets.join(hubs, "s1"), "s1")


def _overlaps(owner: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens each two rows, the first before the second, share; owner ascends. Tokens of many rows go by a matrix
    product, others by the pairs of their rows."""
    out = np.zeros((rows, rows), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(token)))
    many = np.flatnonzero(size > max(2, rows // 16))
    step = max(1, CELLS // rows)
    for k in range(0, len(many), step):
        part = many[k : k + step]
        column = np.repeat(np.arange(len(part)), size[part])
        at = np.repeat(begin[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(len(column))
        held = np.zeros((rows, len(part)), np.float32)
        held[owner[at], column] = 1
        out += held @ held.T
    few = np.flatnonzero((size > 1) & (size <= max(2, rows // 16)))
    flat = out.reshape(-1)
    for distance in range(1, int(size[few].max()) if len(few) else 0):
        far = few[size[few] > distance]
        for k in range(0, len(far), step):
            part = far[k : k + step]
            count = size[part] - distance
            at = np.repeat(begin[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            np.add.at(flat, owner[at] * rows + owner[at + distance], np.float32(1))
    return out


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of a list column."""
    column = table.column(name).combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _linked(table: pa.Table, percent: int, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, counted): the linked pairs of rows of a group; counted: this is the pair's group with the smallest hub."""
    rows = table.num_rows
    n, own = (table.column(k).to_numpy() for k in ("n", "own"))
    a, b = np.triu_indices(rows, 1)
    fine = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    if table.column("b1")[0].as_py() != table.column("b2")[0].as_py():
        fine &= own[a] != own[b]
    a, b = a[fine], b[fine]
    for o in range(orders):
        if len(a):
            shared = _overlaps(*_lists(table, f"p{o}"), rows)[a, b] > 0
            a, b = a[shared], b[shared]
    if not len(a):
        return a, b, np.zeros(0, bool)
    some = np.unique(np.concatenate([a, b]))
    owner, token = _lists(table, "tokens")
    inside = np.isin(owner, some)
    both = _overlaps(np.searchsorted(some, owner[inside]), token[inside], len(some))[np.searchsorted(some, a), np.searchsorted(some, b)].astype(np.int64)
    good = 100 * both >= percent * (n[a] + n[b] - both)
    a, b = a[good], b[good]
    owner, hub = _lists(table, "hubs")
    less = hub < table.column("hub")[0].as_py()
    return a, b, _overlaps(owner[less], hub[less], rows)[a, b] == 0 if less.any() else np.ones(len(a), bool)


def _least_reached(a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The least rep that each row reaches by the pairs."""
    low = rep.copy()
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == low).all():
            return low
        low = new


def group_links(groups: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """(s1, rep, root, links): each set of each group with the least representative that it is connected with there, and
    the number of documents of other sets that it links to."""

    def run(table: pa.Table) -> pa.Table:
        s1, rep, docs = (table.column(k).to_numpy() for k in ("s1", "rep", "docs"))
        a, b, counted = _linked(table, percent, orders)
        links = np.bincount(a[counted], docs[b[counted]], len(s1)) + np.bincount(b[counted], docs[a[counted]], len(s1))
        return pa.table({"s1": s1, "rep": rep, "root": _least_reached(a, b, rep), "links": links.astype(np.int64)})

    return groups.groupBy("hub", "b1", "b2").applyInArrow(run, "s1 long, rep long, root long, links long")


def _classes(docs: DataFrame, n: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's set size and signature; each set's least document and number of documents."""
    rows = space.keep(shingle_sets(docs, n, tokens=False), "rows")
    named = rows.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "doc_id").agg(F.lit(1).alias("one"))
    return rows, space.keep(named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "classes")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): every link between different sets as (sa, sb), sa < sb, and the documents of each set as
    (doc_id, s1), both by signature.

    Documents, their sets and the threshold are those of ngram_components; documents of one set link to each other. A
    group of near copies has as many links as it has pairs: ngram_components counts them without giving them out.
    """

    def run(table: pa.Table) -> pa.Table:
        s1 = table.column("s1").to_numpy()
        a, b, counted = _linked(table, percent, ORDERS)
        a, b = s1[a[counted]], s1[b[counted]]
        return pa.table({"sa": np.minimum(a, b), "sb": np.maximum(a, b)})

    space = Workspace(docs.sparkSession, "ngram-links")
    docs = _plain(docs, id_col, text_col)
    rows, classes = _classes(docs, n, space)
    groups = hub_groups(thinned_sets(docs, classes.drop("s2"), n, percent, space), space)
    return groups.groupBy("hub", "b1", "b2").applyInArrow(run, "sa long, sb long"), rows.filter("n > 0 and doc_id is not null").select("doc_id", "s1").distinct()


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of docs.

    Words are runs of bytes outside \\x20 and \\x09-\\x0D, A-Z lower-cased; two documents link when
    100 * |intersection| >= percent * |union| of their distinct n-word shingles (fewer words: the whole sequence).
    component_id is the smallest id reachable by links, the document's own included; n_links is the number of other
    documents that this row's set links to, equal sets included. All links are verified and counted, none is given out.
    A null or empty text has no shingles and no link. Rows with equal text link; rows that repeat an id are one document,
    and one with several sets is counted once for each of them. A null id keeps its row, with a null component and null
    links. Other columns are ignored. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "ngram-join")
    docs = _plain(docs, id_col, text_col)
    rows, classes = _classes(docs, n, space)
    sets = thinned_sets(docs, classes.drop("s2"), n, percent, space)
    found = space.keep(group_links(hub_groups(sets, space), percent), "links")
    space.drop(sets)
    counts = found.groupBy("s1").agg(F.sum("links").alias("links"))

    held_by = rows.filter("n > 0 and doc_id is not null").join(classes, ["n", "s1", "s2"])
    again = held_by.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    again = held_by.join(again.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    final = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(again).filter("a <> b"), space)
    label = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "s1", "left")
    label = label.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"))
    named = F.col("doc_id").isNotNull()
    return (
        rows.join(label, ["n", "s1", "s2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(named, F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    )
