"""Conversation prefix trie: union-find over the LCP edges of sorted conversations, forests merged across boundaries.

A conversation is the sequence of its turns' 128-bit digests. Conversations are dealt into ranges of the order of sequences and
sorted there, so that all that start alike lie side by side. Each range goes through in blocks. In a block, neighbours are
joined in descending order of the number of turns that they share: two components that meet at a depth have all their nodes
below it finished, and what they have there becomes one node, a branching node where their next turns differ. Turns between two
such nodes are nodes of one child each; those that only one conversation has are written without any joining.

The first and last conversation of a block may go on in its neighbours. What is known of their nodes is kept, everything else
is finished and leaves: a block contracts to two sequences with, at each depth, sums over what hangs there. Contracted blocks
are merged with the next block of their range, contracted ranges in groups of GROUP, then those, until one is left. A node's
children that were finished before it name it by a digest of its turns, and get its smallest member by a join.

Texts are digested before anything is shuffled. One conversation's digests (20 bytes a turn) must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TURNS = 1 << 18  # turns of the conversations that are joined at once
GROUP = 64  # contracted ranges that one task merges
SALTS = 16  # parts that the children of a node are dealt into when they meet it
FAMILY, HEADS = 20, 4  # conversations that share their first turns with one of them, and the number of choices of how many

KINDS = (
    "kind int, conv_id long, depth long, parent long, pkey binary, n_convs long, n_children long, n_leaves long, saved long, sha string, nkey binary, more boolean, "
    "part long, place int, path binary, words array<int>, hang array<array<long>>, first long, body binary"
)
LONGS = pa.list_(pa.list_(pa.int64()))
SCHEMA = pa.schema(
    [("kind", pa.int32()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent")), ("pkey", pa.binary())]
    + [(n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved")]
    + [("sha", pa.string()), ("nkey", pa.binary()), ("more", pa.bool_()), ("part", pa.int64()), ("place", pa.int32()), ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("hang", LONGS), ("first", pa.int64()), ("body", pa.binary())]
)
NODE, SPINE, ENDS = 0, 1, 2
FAR = np.iinfo(np.int64).max


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NOTHING = sha256("")


@dataclass(slots=True)
class Sums:
    """What is known of one node: members, the smallest, leaves and saved tokens below it, children, finished children's rows,
    ids that end here, whether it stood in a contracted block, and whether ids that end here were given out before."""

    n: int = 0
    least: int = FAR
    leaves: int = 0
    saved: int = 0
    kids: int = 0
    rows: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    known: bool = False
    more: bool = False

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.leaves += other.leaves
        self.saved += other.saved
        self.kids += other.kids
        a, b = (self.rows, other.rows) if len(self.rows) >= len(other.rows) else (other.rows, self.rows)
        a.extend(b)
        self.rows = a
        self.ends.extend(other.ends)
        self.known |= other.known
        self.more |= other.more


@dataclass(slots=True)
class Part:
    """A component: a sequence that lies in it, the depth of its unfinished node, that node, what hangs at lower depths, and
    whether it may go on outside of the block."""

    at: int
    depth: int
    node: Sums
    low: dict[int, Sums]
    open: bool = False


@dataclass
class Spine:
    """A sequence of a contracted block: digests, words of each turn, and what hangs at each depth."""

    path: np.ndarray
    words: np.ndarray
    hang: list[Sums]


def shared_depths(path: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many leading turns each sequence shares with the next."""
    size = np.diff(bounds)
    least = np.minimum(size[:-1], size[1:])
    within = np.arange(int(least.sum())) - np.repeat(np.cumsum(least) - least, least)
    a, b = np.repeat(bounds[:-2], least) + within, np.repeat(bounds[1:-1], least) + within
    differs = (path[a] != path[b]).any(1)
    out = least.copy()
    np.minimum.at(out, np.repeat(np.arange(len(least)), least)[differs], within[differs])
    return out


class Block:
    """Joins one block. Rows that it finishes are collected as they come: first those of single conversations, then others."""

    def __init__(self, path: np.ndarray, words: np.ndarray, bounds: np.ndarray, convs: np.ndarray, spines: list[Spine], last: bool):
        self.path, self.words, self.bounds, self.convs, self.spines, self.last = path, words, bounds, convs, spines, last
        self.size = np.diff(bounds)
        self.nodes: list[tuple] = []
        self.chunks: list[tuple] = []

    def run(self) -> list[Spine]:
        """Join everything; the sequences that stay open, none if this is the last block of all."""
        count, given = len(self.size), len(self.spines)
        shared = shared_depths(self.path, self.bounds)
        most = np.zeros(count, np.int64)
        most[:-1] = shared
        most[1:] = np.maximum(most[1:], shared)
        inner = np.arange(count) >= given
        if not self.last:
            inner[[0, -1]] = False
        self._singles(inner, most)
        parts = [self._part(k, bool(inner[k]), int(most[k])) for k in range(count)]
        if not self.last:
            parts[0].open = parts[-1].open = True
        root = list(range(count))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for edge in np.argsort(-shared, kind="stable").tolist():
            a, b = find(edge), find(edge + 1)
            kept = self._join(parts[a], parts[b], int(shared[edge]))
            if kept is not None:
                root[b] = a
                parts[a] = kept
        tops = sorted({find(0), find(count - 1)})
        if self.last:
            self._climb(parts[tops[0]], -1)
            return []
        return [self._contract(parts[k]) for k in tops]

    def _singles(self, inner: np.ndarray, most: np.ndarray) -> None:
        """Nodes that one conversation of the block has alone, and nobody outside of it."""
        tail = np.where(inner, self.size - most, 0)
        self.top = np.cumsum(tail) - tail
        owner = np.repeat(np.arange(len(tail)), tail)
        self.depth = np.arange(len(owner)) - np.repeat(self.top, tail) + most[owner] + 1
        self.conv = self.convs[owner]
        self.leaf = self.depth == self.size[owner]
        self.parent = self.conv.copy()
        self.single = len(owner)
        self.pkeys: dict[int, bytes] = {}

    def _part(self, k: int, inner: bool, most: int) -> Part:
        if k < len(self.spines):
            hang = self.spines[k].hang
            return Part(k, len(hang) - 1, hang[-1], dict(enumerate(hang[:-1])))
        size, conv = int(self.size[k]), int(self.convs[k])
        if inner and size > most:
            return Part(k, most, Sums(1, conv, 1, 0, 1, [int(self.top[k])]), {})
        return Part(k, size, Sums(1, conv, ends=[conv]), {})

    def _join(self, a: Part, b: Part, depth: int) -> Part | None:
        """One component of two neighbours that share depth turns; None if both go on outside, each below that depth."""
        if not a.open:
            self._climb(a, depth)
        if not b.open:
            self._climb(b, depth)
        if a.depth > depth and b.depth > depth:
            return None
        kept, other = (a, b) if a.depth >= b.depth else (b, a)
        if kept.depth == depth:
            kept, other = a, b
            kept.node.add(other.node)
        else:
            kept.low.setdefault(depth, Sums()).add(other.node)
        for d, sums in other.low.items():
            kept.low.setdefault(d, Sums()).add(sums)
        kept.open |= other.open
        return kept

    def _climb(self, part: Part, depth: int) -> None:
        """Finish the nodes of a component below a depth."""
        start = int(self.bounds[part.at])
        while part.depth > depth:
            node, d = part.node, part.depth
            leaves = node.leaves if node.kids else 1
            saved = node.saved + (node.n - 1) * (int(self.words[start + d - 1]) if d else 0)
            row = self.single + len(self.nodes)
            key = self._key(part.at, d) if node.known else None
            self._settle(node.rows, node.least)
            if node.more and node.ends:
                self._give(key, node.ends)
            self.nodes.append([node.least, d, None, node.n, node.kids, leaves, saved, None if node.more else sha256(",".join(map(str, node.ends))) if node.ends else NOTHING, key, node.more])
            if not d:
                part.depth = -1
                return
            part.depth -= 1
            part.node = Sums(node.n, node.least, leaves, saved, 1, [row])
            hung = part.low.pop(part.depth, None)
            if hung is not None:
                part.node.add(hung)

    def _settle(self, rows: list[int], parent: int) -> None:
        for r in rows:
            if r < self.single:
                self.parent[r] = parent
            else:
                self.nodes[r - self.single][2] = parent

    def _key(self, at: int, depth: int) -> bytes:
        start = int(self.bounds[at])
        return hashlib.md5(self.path[start : start + depth].tobytes()).digest()

    def _give(self, key: bytes, ends: list[int]) -> None:
        self.chunks.append((key, ends[0], ",".join(map(str, ends)).encode()))

    def _contract(self, part: Part) -> Spine:
        """The component as one sequence; rows of finished children and ids that end at its nodes are given out."""
        start = int(self.bounds[part.at])
        path, words = self.path[start : start + part.depth], self.words[start : start + part.depth]
        hang = [part.low.get(d, Sums()) for d in range(part.depth)] + [part.node]
        digest = hashlib.md5()
        for d, sums in enumerate(hang):
            if d:
                digest.update(path[d - 1].tobytes())
            if sums.rows or sums.ends:
                key = digest.copy().digest()
                for r in sums.rows:
                    self.pkeys[r] = key
                if sums.ends:
                    self._give(key, sums.ends)
                    sums.more = True
            sums.rows, sums.ends, sums.known = [], [], True
        return Spine(path, words, hang)

    def batch(self) -> pa.RecordBatch:
        """Finished nodes and given ids."""
        n, m = self.single, len(self.nodes)
        total = n + m + len(self.chunks)
        alone = np.ones(n, np.int64)
        columns = {"kind": [NODE] * (n + m) + [ENDS] * len(self.chunks)}
        shas = [sha256(str(c)) if leaf else NOTHING for c, leaf in zip(self.conv.tolist(), self.leaf.tolist(), strict=True)]
        own = [self.conv.tolist(), self.depth.tolist(), self.parent.tolist(), alone.tolist(), (alone - self.leaf).tolist(), alone.tolist(), (0 * alone).tolist(), shas, [None] * n, [False] * n]
        nones = [None] * len(self.chunks)
        names = ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "sha", "nkey", "more")
        for k, name in enumerate(names):
            columns[name] = own[k] + [r[k] for r in self.nodes] + nones
        keys: list[bytes | None] = [None] * total
        for r, key in self.pkeys.items():
            keys[r] = key
            columns["parent"][r] = None
        columns["pkey"] = keys
        columns["nkey"][n + m :] = [c[0] for c in self.chunks]
        columns["first"] = [None] * (n + m) + [c[1] for c in self.chunks]
        columns["body"] = [None] * (n + m) + [c[2] for c in self.chunks]
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * total), f.type) for f in SCHEMA], schema=SCHEMA)


def _spine_batch(part: int, spines: list[Spine]) -> pa.RecordBatch:
    """Open sequences as rows; what hangs at a depth is a list of its numbers."""
    columns = {
        "kind": [SPINE] * len(spines),
        "part": [part] * len(spines),
        "place": list(range(len(spines))),
        "path": [s.path.tobytes() for s in spines],
        "words": [s.words.tolist() for s in spines],
        "hang": [[[x.n, x.least, x.leaves, x.saved, x.kids, int(x.more)] for x in s.hang] for s in spines],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(spines)), f.type) for f in SCHEMA], schema=SCHEMA)


def _joined(spines: list[Spine], path: np.ndarray, words: np.ndarray, bounds: np.ndarray, convs: np.ndarray, last: bool = False) -> tuple[pa.RecordBatch, list[Spine]]:
    sizes = np.concatenate([np.array([len(s.path) for s in spines], np.int64), np.diff(bounds)])
    held = np.concatenate([*(s.path for s in spines), path]), np.concatenate([*(s.words for s in spines), words])
    block = Block(*held, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([np.zeros(len(spines), np.int64), convs]), spines, last)
    left = block.run()
    return block.batch(), left


NO_PATH, NO_LONGS = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, path, words) of one range -> finished nodes, and its contracted forest."""
    spines: list[Spine] = []
    for batch in batches:
        convs = batch.column(0).to_numpy(zero_copy_only=False)
        lists, counts = batch.column(1), batch.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        path = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, 2)
        words = counts.values.slice(counts.offsets[0].as_py(), len(path)).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        at = 0
        while at < len(convs):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_TURNS, "right")) - 1)
            s, e = offsets[at], offsets[to]
            found, spines = _joined(spines, path[s:e], words[s:e], offsets[at : to + 1] - s, convs[at:to])
            yield found
            at = to
    if spines:
        yield _spine_batch(TaskContext.get().partitionId(), spines)


def _merge(last: bool) -> Callable[[pa.Table], pa.Table]:
    """A function that makes one of the contracted forests of a group of neighbouring ranges."""
    return lambda table: _merged(table, last)


def _merged(table: pa.Table, last: bool) -> pa.Table:
    rows = table.sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()
    spines = []
    for r in rows:
        hang = [Sums(n, least, leaves, saved, kids, known=True, more=bool(more)) for n, least, leaves, saved, kids, more in r["hang"]]
        spines.append(Spine(np.frombuffer(r["path"], np.uint64).reshape(-1, 2), np.array(r["words"], np.int64), hang))
    found, left = _joined(spines, NO_PATH, NO_LONGS, np.zeros(1, np.int64), NO_LONGS, last)
    return pa.Table.from_batches([found, *([_spine_batch(rows[0]["part"] // GROUP, left)] if left else [])])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (nkey, first, body) -> (nkey, sha) of the joined bodies of each key; a key may go over many batches."""
    key, state = None, hashlib.sha256()
    names = ["nkey", "ends"]
    for batch in batches:
        done = []
        for k, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(body)
            else:
                state.update(b"," + body)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names)


def rebuilt_paths(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, path, words): each conversation's turns after its first h, behind the first h turns of conversation
    conv_id - conv_id % family, as digests and numbers of words; h is the CRC-32 of the decimal conv_id modulo heads.

    Turns are in order of turn, null first; turns of one number by the digest of role and text, of which nulls are empty.
    Rows without conv_id are left out; other columns are ignored. % is that of SQL, so it has the sign of conv_id.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.md5(said)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("own"))
    first = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left").withColumn("h", h)
    whole = F.concat(F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h"))), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return both.withColumn("whole", whole).select("conv_id", F.transform("whole", lambda t: t["digest"]).alias("path"), F.transform("whole", lambda t: t["words"]).alias("words"))


def trie_nodes(paths: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of
    paths (conv_id, path, words): see prefix_trie."""
    tables = [space.keep(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "words").mapInArrow(_forests, KINDS), "forests")]
    parts = tables[0].filter(F.col("kind") == SPINE).agg(F.max("part")).first()[0]
    while parts is not None:
        last = parts < GROUP
        groups = tables[-1].filter(F.col("kind") == SPINE).groupBy(F.floor(F.col("part") / GROUP).alias("g"))
        tables.append(space.keep(groups.applyInArrow(_merge(last), KINDS), "merged"))
        parts = None if last else parts // GROUP
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    nodes = rows.filter(F.col("kind") == NODE)
    ends = rows.filter(F.col("kind") == ENDS).select("nkey", "first", "body").repartition("nkey").sortWithinPartitions("nkey", "first").mapInArrow(_digests, "nkey binary, ends string")
    ends = space.keep(ends, "ends")
    held = nodes.filter("nkey is not null").select(F.col("nkey").alias("__key"), F.col("conv_id").alias("__least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    own = nodes.select("conv_id", "depth", "parent", "pkey", "n_convs", "n_children", "n_leaves", "saved", "sha", "nkey")
    waiting = own.filter("pkey is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    met = waiting.join(held, (F.col("pkey") == F.col("__key")) & (F.col("salt") == F.col("__salt"))).withColumn("parent", F.col("__least"))
    both = own.filter("pkey is null").union(met.select(own.columns))
    named = both.filter("sha is null").join(ends, "nkey").withColumn("sha", F.col("ends")).select(own.columns)
    return both.filter("sha is not null").union(named).select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (rebuilt_paths), the root at depth 0 included: conv_id, its
    smallest member; depth; parent_conv_id, its parent's smallest member, null for the root; n_convs members; n_children;
    n_leaves, nodes without children in its subtree, which includes the node; saved_tokens, the sum over its subtree of
    (members - 1) times the words of each node's last turn; ends_sha256, the SHA-256 of the decimal ids, ascending and
    comma-joined, of the members that have no further turn.

    Null roles and texts are empty ones; rows without conv_id are left out; a repeated row is a turn of its own; turns of
    equal number go by their digest; a conversation whose turns all fall away is a member of the root alone. Other columns
    are ignored. An empty table gives an empty table.
    """
    return trie_nodes(rebuilt_paths(conversations), Workspace(conversations.sparkSession, "prefix-trie"))
