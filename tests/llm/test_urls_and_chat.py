"""URL cascade and tool-call linking against plain Python."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbed.llm import url_filter
from reedbed.llm.chat import SCHEMAS, call_levels, format_conversations, link_calls
from reedbed.llm.store import Workspace
from reedbed.llm.url_filter import LISTED_LABELS, RULES, build_cascade, in_cascade, judge_urls


@pytest.mark.parametrize(("listed", "others"), [(0, 0), (0, 50), (50, 0), (300, 5000), (4000, 300)])
def test_cascade_is_exact(listed, others):
    keys = np.random.default_rng(listed + others).choice(1 << 40, listed + others, replace=False).astype(np.uint64)
    cascade = build_cascade(keys[:listed], keys)
    assert in_cascade(cascade, keys).tolist() == [True] * listed + [False] * others


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else (0, None, None)
    listed = any(x in LISTED_LABELS for x in host.split("."))
    return host, path, rule[1], rule[2] or ("block" if listed else "allow")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_judge_urls(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 8)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/8", "https://xexample.com/en/71", "http://a.org/es/", "http://org/es/1", "http://de.net/de/8", "http://a.example.net/de/81", "http://www.casino-win.example.org/fr", "http://casino-win.example.com/en/7", "a://b://c/d", "http://x\n/y", "http://É.com/en/"]
    urls += [f"http://h{k}.example.com/fr/{k}" for k in range(60)] + [f"http://ads-track.h{k}.org/p" for k in range(20)] + urls[4:8]
    pages = spark.createDataFrame([(k, u, "key", 1, True) for k, u in enumerate(urls)], "page_id long, url string, key string, shard int, member boolean")
    got = {r["page_id"]: tuple(r)[1:5] for r in judge_urls(pages).collect()}
    assert got == {k: plain(u) for k, u in enumerate(urls)}
    assert judge_urls(pages.limit(0)).count() == 0


def test_rules_have_the_words_of_their_contract(spark):
    """Each rule's word on a url that it alone decides, listed hosts included."""
    words = {"http://a.com/en/1": ("com/en/", "block"), "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://ads-track.net/de/1": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/1": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(words)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in judge_urls(pages).orderBy("page_id").collect()] == list(words.values())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_filter_urls_by_a_list(spark, limit, monkeypatch):
    """A table of listed keys, clashing column names, null keys, repeated and very long urls."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 8)
    rows = [(k, k if k % 9 else None, "s", b"c", 1.5) for k in range(80)] * 2
    urls = spark.createDataFrame(rows, "shard long, key long, part string, cascade binary, u0 double")
    listed = spark.createDataFrame([(k,) for k in [*range(0, 200, 5), 3, 3, None]], "key long")
    out = url_filter.filter_urls(urls, listed, Workspace(spark, "t"))
    assert out.columns == [*urls.columns, "member"]
    want = sorted(((*r, r[1] is not None and (r[1] % 5 == 0 or r[1] == 3)) for r in rows), key=str)
    assert sorted(((*r[:3], bytes(r[3]), *r[4:]) for r in out.collect()), key=str) == want
    assert url_filter.filter_urls(urls.limit(0), listed.limit(0), Workspace(spark, "t")).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 300_000), (2, "http://b.com/y"), (3, None)], "page_id long, url string")
    own = url_filter.url_keys(pages.filter("page_id = 1")).select("key")
    assert {r["page_id"]: r["verdict"] for r in judge_urls(pages, own).collect()} == {1: "block", 2: "allow", 3: "allow"}


CALLS = "conv_id long, call_id string, turn long, name string, arguments map<string,string>, needs array<string>"


def test_link_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 1, "f", {"x": "1", "s": '"t"'}, []),
            (1, "b", 2, "f", {"x": '"no"', "s": '"t"', "z": "1"}, ["a"]),
            (1, "c", 3, "g", None, ["b", "a", "gone"]),
            (1, "a", 1, "f", {"x": "1", "s": '"t"'}, []),
            (2, "p", 1, "f", {"x": "2.5"}, ["q"]),
            (2, "q", 2, "f", {"x": "2", "s": '"\\""'}, ["p"]),
        ],
        CALLS,
    )
    results = spark.createDataFrame([("a", 2, "ok"), ("a", 2, "ok"), ("a", 1, "first"), ("x", 1, "lost"), (None, 1, "none")], "call_id string, turn long, content string")
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "s", "string", True)], SCHEMAS)
    got = {r["call_id"]: r for r in link_calls(calls, results, schemas, Workspace(spark, "t")).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "p": None, "q": None}
    assert {k: r["problems"] for k, r in got.items()} == {"a": "", "b": "type:x,unknown:z", "c": "no schema", "p": "missing:s,type:x", "q": ""}
    assert json.loads(got["a"]["json"]) == {"arguments": {"s": "t", "x": 1}, "id": "a", "name": "f", "results": ["first", "ok"]}
    assert got["a"]["json"] == json.dumps(json.loads(got["a"]["json"]), sort_keys=True, separators=(",", ":"))
    assert got["a"]["n_results"] == 3 and got["c"]["n_results"] == 0


def test_format_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'Say "é"?\n'), (1, 2, "assistant", "é"), (1, 3, "user", None), (None, 1, "user", "x"), (2, 0, "user", ""), (2, 0, "user", "")]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, level int")
    got = {r["call_id"]: r for r in format_conversations(frame).collect()}
    assert set(got) == {"call-1-1", "call-1-3", "call-2-0"}
    assert json.loads(got["call-1-1"]["json"])["arguments"] == {"n_words": 2, "text": 'Say "é"?\n', "system": "s"}
    assert got["call-1-1"]["n_results"] == 1 and got["call-1-3"]["level"] == 1 and json.loads(got["call-1-1"]["json"])["arguments"]["system"] == "s" and all(r["valid"] for r in got.values())
    assert format_conversations(frame.limit(0)).count() == 0
    assert frame.filter(F.col("role") == "user").count() == 5


def plain_chat(rows):
    """Calls, results and lone turns of conversations, one after the other."""
    texts = {}
    for c, turn, role, text in rows:
        if c is not None and turn is not None:
            texts.setdefault((c, turn, role), set()).add(text or "")
    said = {k: "\n".join(sorted(v)) for k, v in texts.items()}
    out = []
    for c in {k[0] for k in said}:
        own = sorted(((t, r != "user", r or ""), r, x) for (k, t, r), x in said.items() if k == c)
        system = [x for _, r, x in own if r == "system"]
        calls, lone = [], []
        for (turn, *_), role, text in own:
            if role == "user":
                calls.append([turn, text, []])
            elif role != "system":
                (calls[-1][2] if calls else lone).append((turn, text))
        for level, (turn, text, results) in enumerate(calls):
            arguments = {"n_words": len(re.findall(r"[^\x20\x09-\x0D]+", text)), "text": text}
            if system and not level:
                arguments["system"] = "\n".join(system)
            body = {"arguments": arguments, "id": f"call-{c}-{turn}", "name": "question" if "?" in text else "statement", "results": [x for _, x in sorted(set(results))]}
            out.append((c, body["id"], turn, body["name"], level, len(results), True, "", json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
        for turn in sorted({t for t, _ in lone}):
            here = [x for t, x in lone if t == turn]
            out.append((c, None, turn, None, 0, len(here), False, "no call", json.dumps({"id": None, "results": sorted(set(here))}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_of_any_order(spark, seed):
    """Tool turns, several answers, answers before any call, two roles in one turn, repeated rows and nulls."""
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "tool", "system", None]
    rows = [(int(rng.integers(0, 25)), int(rng.integers(0, 9)), roles[int(rng.integers(0, 5))], ["a", "b?", "", "é \n c", None][int(rng.integers(0, 5))]) for _ in range(300)]
    rows += rows[:20] + [(None, 1, "user", "x"), (1, None, "user", "y"), (90, 3, "assistant", "alone"), (91, 0, "user", "long " * 30_000), (91, 1, "tool", "t"), (91, 2, "assistant", "u"), (91, 3, "assistant", "v")]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, level int")
    got = sorted((tuple(r) for r in format_conversations(frame).collect()), key=str)
    assert got == plain_chat(rows)


def test_calls_without_id_and_clashing_calls_stay_defined(spark):
    calls = [(1, None, 1, "f", {"x": "1"}, ["a"]), (1, None, 1, "f", {"x": "1"}, None), (1, "a", 2, "g", None, None), (1, "a", 1, "g", {"x": "2"}, None), (1, "a", 1, "f", {"x": "3"}, None)]
    schemas = spark.createDataFrame([("f", "x", "integer", True)], SCHEMAS)
    out = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(None, 1, "n")], "call_id string, turn long, content string"), schemas, Workspace(spark, "t")).collect()
    assert sorted((r["call_id"] or "", r["name"], r["level"], r["json"]) for r in out) == [("", "f", 0, '{"arguments":{"x":1},"id":null,"name":"f","results":[]}')] * 2 + [("a", "f", 0, '{"arguments":{"x":3},"id":"a","name":"f","results":[]}')]


def test_arguments_become_canonical_json(spark):
    texts = {"a": '{"b": 1, "a": {"d": [1, {"z": 2, "y": null}]}}', "b": '"a" , "b"', "c": "2.50", "d": "tru", "e": '1, "c": 2', "f": "1], [2", "g": '"\\u00e9"', "h": None, "i": "1}", "j": "true", "k": ""}
    schemas = spark.createDataFrame([("f", k, v, False) for k, v in (("a", "object"), ("b", "string"), ("c", "number"), ("g", "string"), ("j", "boolean"), ("h", "string"))], SCHEMAS)
    r = link_calls(spark.createDataFrame([(1, "x", 1, "f", texts, None)], CALLS), spark.createDataFrame([], "call_id string, turn long, content string"), schemas, Workspace(spark, "t")).first()
    good = {"a": {"a": {"d": [1, {"y": None, "z": 2}]}, "b": 1}, "c": 2.5, "g": "é", "h": None, "j": True}
    assert json.loads(r["json"])["arguments"] == texts | good
    assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert r["problems"] == "json:b,json:d,json:e,json:f,json:i,json:k,type:h"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_against_brute_force(spark, seed):
    """Long chains, joins of chains, cycles and what waits for them, and needs of unknown calls."""
    rng = np.random.default_rng(seed)
    n = 150
    needs = {k: set() for k in range(n)}
    for k in range(1, n):
        if k % 50:
            needs[k].add(k - 1)
        for _ in range(int(rng.integers(0, 8)) // 6):
            needs[k].add(int(rng.integers(0, k)))
    if seed > 1:
        needs[20].add(int(rng.integers(20, 40)))
    if seed > 2:
        needs[100] = {100}
    needs[7].add(999)
    level, more = {}, True
    while more:
        found = {k: max((level[x] + 1 for x in v if x < n), default=0) for k, v in needs.items() if k not in level and all(x in level or x >= n for x in v)}
        level |= found
        more = bool(found)
    calls = spark.createDataFrame([(str(k),) for k in needs], "call_id string")
    pairs = spark.createDataFrame([(str(k), str(x)) for k, v in needs.items() for x in v], "call_id string, needed string")
    got = {int(r["call_id"]): r["level"] for r in call_levels(calls, pairs, Workspace(spark, "t")).collect()}
    assert got == {k: level.get(k) for k in needs} and (seed == 1) == all(v is not None for v in got.values())
