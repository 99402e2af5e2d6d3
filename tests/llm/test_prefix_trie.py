"""Conversation trie against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from reedbed.llm import prefix_trie as P
from reedbed.llm.prefix_trie import prefix_trie, trie_nodes
from reedbed.llm.store import Workspace

ROWS = "conv_id long, turn long, role string, text string, kind int, part long"


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said = (role or "", text or "")
            key = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), said))
    own = {c: [s for _, s in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(paths):
    """Nodes of {conv_id: turns}."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(case):
    draw = random.Random(case)
    rows = []
    for c in range([0, 1, 60, 150, 120][case]):
        turns = draw.randrange(1, [2, 2, 9, 6, 4][case])
        for t in range(turns):
            text = "same words here" if case == 4 and t < 2 and c % 3 else " ".join(draw.choices("a b".split(), k=draw.randrange(0, 3)))
            rows.append((c * (1 if case != 3 else 7), draw.choice([t, t, None]) if case == 2 else t, draw.choice(["user", "user", None]), text or None, 1, 2))
    if case == 3:
        rows += rows[:40] + [(None, 1, "user", "x", 1, 2)] + [(900_000, t, "user", f"turn {t}", 1, 2) for t in range(300)] + [(900_020, t, "user", f"turn {t}", 1, 2) for t in range(280)]
    return rows


@pytest.mark.parametrize("turns", [1 << 18, 7])
@pytest.mark.parametrize("case", range(1, 5))
def test_prefix_trie(spark, case, turns, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TURNS", turns)
    monkeypatch.setattr(P, "GROUP", 2)
    rows = made(case)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)
    assert got == brute(rebuilt(rows))


def test_many_blocks_without_spark(monkeypatch):
    """Forests of blocks and ranges of every size, merged, against plain Python."""

    draw = random.Random(8)
    for _ in range(60):
        paths = {c: [("user", draw.choice("xyz")) for _ in range(draw.randrange(0, 6))] for c in range(draw.randrange(1, 40))}
        digest = lambda t: hashlib.md5(t[1].encode()).digest()
        line = sorted(((b"".join(map(digest, t)), c) for c, t in paths.items()))
        spines, nodes, ends = [], [], {}
        cuts = sorted(draw.sample(range(1, len(line)), min(len(line) - 1, draw.randrange(0, 6))))
        step = lambda b: [nodes.append(r) if r["kind"] == P.NODE else ends.setdefault(r["nkey"], []).append((r["first"], r["body"])) for r in b.to_pylist()]
        for s, e in zip([0, *cuts], [*cuts, len(line)], strict=True):
            part = [np.frombuffer(p, np.uint64).reshape(-1, 2) for p, _ in line[s:e]]
            flat = np.concatenate([P.NO_PATH, *part])
            found, spines = P._joined(spines, flat, np.ones(len(flat), np.int64), np.cumsum([0, *(len(p) for p in part)]).astype(np.int64), np.array([c for _, c in line[s:e]], np.int64))
            step(found)
        found, left = P._joined(spines, P.NO_PATH, P.NO_LONGS, np.zeros(1, np.int64), P.NO_LONGS, True)
        step(found)
        assert not left
        least = {r["nkey"]: r["conv_id"] for r in nodes if r["nkey"] is not None}
        sha = {k: hashlib.sha256(b",".join(b for _, b in sorted(v))).hexdigest() for k, v in ends.items()}
        got = [(r["conv_id"], r["depth"], least[r["pkey"]] if r["pkey"] else r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["sha"] or sha[r["nkey"]]) for r in nodes]
        assert sorted(got, key=str) == brute(paths)


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, 2)], ROWS)).count() == 0
    paths = spark.createDataFrame([(k, [], []) for k in range(5)], "conv_id long, path array<binary>, words array<int>")
    want = hashlib.sha256(b"0,1,2,3,4").hexdigest()
    assert [tuple(r) for r in trie_nodes(paths, Workspace(spark, "t")).collect()] == [(0, 0, None, 5, 0, 1, 0, want)]
