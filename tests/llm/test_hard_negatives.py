"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest

from reedbed.llm import hard_negatives as H
from reedbed.llm.hard_negatives import hard_negatives, pack_planes, scores, subset_tables


@pytest.mark.parametrize(("most", "bits", "kind"), [(1, 2, np.int32), (130, 9, np.int32), (130, 9, np.int64), (10**7, 25, np.int64), (2**28, 30, np.int64)])
def test_scores_are_inner_products(most, bits, kind):
    draw = np.random.default_rng(most)
    a, b = draw.integers(-most, most + 1, (7, 24)), draw.integers(-most, most + 1, (50, 24))
    a[0], b[0], b[1] = most, -most, 0
    assert (scores(pack_planes(b, bits), subset_tables(a, kind)) == b @ a.T).all()


def brute(rows):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2.0**62 / 256 for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        held[i] = min(held.get(i, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in held:
        if a % 50:
            continue
        label, v = held[a]
        all_ = sorted((-dot(v, w), i, own == label) for i, (own, w) in held.items() if i != a)
        for p, i, _ in [x for x in all_ if x[2]][:5]:
            fits = [x for x in all_ if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(a, i, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def made(case):
    draw = random.Random(case)
    n = [400, 300, 260][case]
    vector = lambda: [draw.gauss(0, 0.2) for _ in range([16, 3, 12][case])]
    rows = [(k * (5 if case else 1), vector(), draw.randrange(10)) for k in range(n)]
    if case == 1:
        hot = vector()
        rows = [(i, hot if k % 3 == 0 else v, 4 if k % 2 else y) for k, (i, v, y) in enumerate(rows)]
        rows += rows[:20] + [(0, vector(), 1), (50, vector(), 0)]
    if case == 2:
        rows += [(None, vector(), 1), (10_000, None, 1), (10_050, vector(), None), (10_100, [0.1, None], 1), (10_150, [float("nan")] * 12, 1), (10_200, [float("inf")], 1), (10_250, [1e30], 1), (10_300, [], 2), (10_350, [0.5, 0.25], 3), (10_400, [1.0] * 20, 3)]
    return rows


@pytest.mark.parametrize("block", [2048, 40])
@pytest.mark.parametrize("case", range(3))
def test_hard_negatives(spark, case, block, monkeypatch):
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3 if block == 40 else block)
    monkeypatch.setattr(H, "ROW_BLOCK", block)
    monkeypatch.setattr(H, "LANES", 2 if block == 40 else 64)
    rows = made(case)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, q int")
    want = brute(rows)
    assert sorted(tuple(r) for r in hard_negatives(df).collect()) == want and want


def test_empty(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1), (50, None, 1)], kind)).count() == 0
