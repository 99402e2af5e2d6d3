"""Source mixing: apportionment against sorted quotients, the mix against its targets."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reedbed.llm import mixing
from reedbed.llm.mixing import apportion, mix_report, mixed_spans, mixed_texts, shard_quota
from reedbed.llm.store import Workspace


def highest(votes, limits, seats):
    """Seats by the highest quotients; ties by place."""
    quotients = sorted((-Fraction(v) / (2 * k + 1), i) for i, (v, limit) in enumerate(zip(votes, limits, strict=True)) for k in range(limit) if v > 0)
    out = [0] * len(votes)
    for _, i in quotients[:seats]:
        out[i] += 1
    return out


@pytest.mark.parametrize("case", range(7))
def test_apportion(spark, case):
    draw = random.Random(case)
    n = [1, 5, 12, 12, 30, 8, 3][case]
    votes = [float(draw.choice([7, 7, 7, 90, 1000, 0])) if case in (2, 4) else draw.uniform(0, 500) for _ in range(n)]
    limits = [draw.randrange(0, 9) if case == 3 else 60 for _ in range(n)]
    seats = [10, 33, 61, 25, 100, 10_000, 0][case]
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(votes, limits, strict=True))], "i long, votes double, limit long")
    got = [r["seats"] for r in apportion(df, seats, F.col("i"), Workspace(spark, "t")).orderBy("i").collect()]
    assert got == highest(votes, limits, seats)


def test_shard_quota(spark):
    draw, size = random.Random(3), 6
    rows = []
    for _ in range(150):
        blocks = draw.randrange(1, 40)
        seats = draw.randrange(0, 2 * blocks + 1)
        parts = [size] * (blocks // size) + [blocks % size] * (blocks % size > 0)
        rows += [(k, blocks, seats, q) for k, q in enumerate(highest(parts, [2 * p for p in parts], seats))]
    df = spark.createDataFrame(rows, "shard long, blocks long, seats long, want long")
    got = df.withColumn("got", shard_quota(F.col("shard"), F.col("blocks"), F.col("seats"), size, 2)).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def targets(sizes):
    """Targets by sharing again until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, Fraction(3 * sum(sizes.values()), 2), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: float(left * weight[s] / total) for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over


def made(spark, n=400):
    draw = random.Random(9)
    rows = [(k, None if k % 37 == 0 else " ".join(f"w{k}x{j}" for j in range(draw.randrange(0, 300))), draw.choice(["a", "a", "a", "a", "b", "z", "é", None])) for k in range(n)]
    rows += [(n, "one\ttwo\n three ", "tiny"), (n + 1, "", "void"), (n + 2, " ".join(["long"] * 20_000), "z"), (None, "x y", "b"), (None, None, None), (5, "again " * 40, "a"), (5, "again " * 40, "a")]
    return rows, spark.createDataFrame([(*r, 1, "no") for r in rows], "doc_id long, text string, source string, size int, row string")


@pytest.mark.parametrize("shard", [4096, 8])
def test_mix(spark, shard, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", shard)
    rows, docs = made(spark)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    want = targets(sizes)
    got = mixed_spans(docs.repartition(5)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source"] or "") for r in got) == sorted((d if d is not None else -1, count(t), s or "") for d, t, s in rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum((s["end"] - s["start"]) * s["times"] for s in r["spans"])
        flat = [x for s in r["spans"] for x in (s["start"], s["end"])]
        assert flat == sorted(flat) and (not flat or (flat[0] >= 0 and flat[-1] <= r["size"]))
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 3 * mixing.BLOCK_WORDS
    again = mix_report(docs.repartition(3))
    key = lambda rows: sorted(tuple(-1 if x is None else x for x in r) for r in rows)
    assert key(again.collect()) == key((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)


def test_mixed_texts_and_empty(spark):
    rows, docs = made(spark, 60)
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    words: dict[int, int] = {}
    for r in mixed_texts(docs).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in mix_report(docs).collect() if r["taken"]}
    assert mix_report(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mix_report(docs.filter("size = 1").select("doc_id", F.lit(None).cast("string").alias("text"), "source")).collect()] == [0] * docs.count()
