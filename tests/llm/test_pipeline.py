"""The corpus pipeline: stage by stage, as a whole, against brute force, and on odd tables."""

import os

import numpy as np
import pytest
from test_documents import base_spans, brute_components, edit_distance, encoding, quality

import corpus_pipeline

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, th long, token string, host string"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        rows = docs.collect()
        assert docs.columns == columns, name
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert counts[3] == counts[4]
    final = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert final.count() == counts[-1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r["doc_id"] for r in rows)


def brute(rows, items):
    """Rows (doc_id, text, ...) of distinct ids after the first four stages, by plain loops; no line is frequent here."""
    rows = [r for r in rows if not quality(r[1])[-1]]
    component = {r[0]: c for r, (_, _, c, _) in zip(sorted(rows), brute_components(sorted(rows), 5, 80), strict=True)}
    rows = [r for r in rows if component[r[0]] == r[0]]
    rows = [r for r in rows if all(edit_distance(i.lower().split(), r[1].lower().split()) > len(i.split()) // 5 for i in items)]
    out = []
    for r in rows:
        text, at = "", 0
        for start, _, end in base_spans(r[1]):
            if start >= at:
                text += r[1][at:start] + "[SECRET]"
            at = max(at, end)
        out.append((r[0], text + r[1][at:]))
    return sorted(out)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 500, n)]
    items = [" ".join(words(15)) for _ in range(6)]
    rows = []
    for k in range(90):
        own = words(int(rng.integers(4, 60)))
        if k % 9 == 0:
            own = rows[k // 2][1].split() if k else own
            own[len(own) // 2] = "new"
        if k % 10 == 3:
            item = items[int(rng.integers(6))].split()
            item[int(rng.integers(15))] = "edited"
            own[3:3] = item
        if k % 10 == 5:
            own[2:2] = ["password:", f"hunter{k}hunter{k}", "deadbeef00112233"]
        if k % 10 == 7:
            own = own[:6] * 5
        rows.append((k, " ".join(own), "en", f"s{k % 3}", 0))
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, items)
    got = sorted((r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(k, len(ids := encoding().encode_ordinary(t)), ids) for k, t in want] and 30 < len(got) < 80


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, nulls in every column, clashing names and no n_chars."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "some words of a text that is long enough to be kept by every rule here"
    rows = [(1, text), (1, text), (1, text.replace("some", "other")), (None, text), (None, text), (2, None), (None, None), (3, "x one two three four five six seven eight nine ten y"), (None, "one two three four five six seven eight nine ten")]
    full = spark.createDataFrame([(*r, "x" if k % 2 else None, None if k == 3 else "s", None if k % 3 else 1, "h", 2, "t", "o") for k, r in enumerate(rows)], SCHEMA)
    want = {
        "quality": sorted([r for r in rows if r[1]], key=str),
        "near_duplicates": sorted([*set(rows[:3]), (2, None), rows[7], *[r for r in rows if r[0] is None]], key=str),
        "decontamination": sorted([r for r in rows if not r[1] or "three" not in r[1]], key=str),
        "secrets": sorted(rows, key=str),
    }
    for table in (full, full.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "encoding":
                assert out.columns == table.columns, name
                assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == want[name], name
            assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
