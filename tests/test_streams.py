"""Streams of several batches: events out of order, late events, and jobs that break off and start again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reedbed.operators import seminars as M
from reedbed.operators.ops import session_activity
from reedbed.streaming import jobs as ST

START = datetime.datetime(2024, 1, 1)
EVENTS = "paper_key string, seq long, ts timestamp, actor_id long, action string, eligible boolean, successor long, successor_eligible boolean"


def as_stream(spark, frames, folder):
    """A stream of one batch a frame."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.option("maxFilesPerTrigger", 1).schema(frames[0].schema).parquet(f"{folder}/in")


def seminar_rows(n=240):
    draw = random.Random(2)
    actions = ["call", "join", "lead", "unhost", "announce", "finish", "leave"]
    return [(f"p{draw.randrange(4)}", k, START + datetime.timedelta(minutes=10 * k), draw.randrange(3), draw.choice(actions), draw.random() > 0.1, draw.choice([None, 0, 1, 2]), True) for k in range(n)]


def test_seminar_state_out_of_order(spark, tmp_path):
    rows = seminar_rows()
    draw = random.Random(3)
    late = [(min(5, k // 40 + (draw.random() < 0.3)), r) for k, r in enumerate(rows)]
    frames = []
    for part in range(6):
        own = [r for p, r in late if p == part]
        draw.shuffle(own)
        frames.append(spark.createDataFrame(own, EVENTS))
    got = ST.run_to_end(ST.stream_seminar_state(as_stream(spark, frames, f"{tmp_path}/a"), "10 hours"), f"{tmp_path}/a")
    want = M.seminar_fold(spark.createDataFrame(rows, EVENTS)).filter(F.col("seq") <= 239 - 60)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(want) and got.count() == 180


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = seminar_rows(200)
    frames = [spark.createDataFrame(rows[:50], EVENTS), spark.createDataFrame(rows[52:120], EVENTS), spark.createDataFrame(rows[120:160], EVENTS), spark.createDataFrame([*rows[160:], *rows[50:52]], EVENTS)]
    got = ST.run_to_end(ST.stream_seminar_state(as_stream(spark, frames, f"{tmp_path}/a"), "1 hour"), f"{tmp_path}/a")
    want = M.seminar_fold(spark.createDataFrame(rows[:50] + rows[52:], EVENTS)).filter(F.col("seq") <= 199 - 6)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(want)


def test_last_used_out_of_order(spark, tmp_path):
    draw = random.Random(4)
    rows = [(k, k % 3, START + datetime.timedelta(seconds=25 * k), k > 150 and k % 50 == 0) for k in range(300)]
    mixed = [(min(4, k // 60 + (draw.random() < 0.4)), r) for k, r in enumerate(rows)]
    kind = "id long, token long, ts timestamp, revokes boolean"
    frames = [spark.createDataFrame([r for p, r in mixed if p == part], kind) for part in range(5)]
    got = ST.run_to_end(ST.stream_last_used(as_stream(spark, frames, f"{tmp_path}/a"), "30 minutes"), f"{tmp_path}/a")
    want = session_activity(spark.createDataFrame(rows, kind)).filter(F.col("id") <= 299 - 72)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def broken(write, at, when):
    """write, but its batch at breaks off: before it, between its tables, or after it."""

    def run(batch, number):
        if number == at and when == "before":
            raise RuntimeError("broken")
        if number == at and when == "between":
            store, count = ST._store, [0]

            def half(*args):
                count[0] += 1
                if count[0] > 1:
                    raise RuntimeError("broken")
                store(*args)

            ST._store = half
            try:
                write(batch, number)
            finally:
                ST._store = store
        write(batch, number)
        if number == at and when == "after":
            raise RuntimeError("broken")

    return run


@pytest.mark.parametrize("when", ["before", "between", "after"])
def test_nothing_is_mailed_twice(spark, tmp_path, when):
    rows = [(k, k % 3, f"n{k}", k % 7 == 0, False, START + datetime.timedelta(hours=5 * k)) for k in range(60)]
    kind = "id long, user_id long, content string, read boolean, emailed boolean, created_at timestamp"
    frames = [spark.createDataFrame(rows[k : k + 15], kind) for k in range(0, 60, 15)]
    users = spark.createDataFrame([(k, f"u{k}@x", f"U{k}") for k in range(3)], "id long, email string, display_name string")
    stream = ST.stream_digest(as_stream(spark, frames, f"{tmp_path}/a"), users)
    with pytest.raises(Exception, match="broken"):
        ST.each_batch(stream, broken(ST.mail_once(f"{tmp_path}/out"), 2, when), f"{tmp_path}/state")
    ST.each_batch(stream, ST.mail_once(f"{tmp_path}/out"), f"{tmp_path}/state")
    ST.each_batch(stream, ST.mail_once(f"{tmp_path}/out"), f"{tmp_path}/other")
    mails = spark.read.parquet(f"{tmp_path}/out/mails")
    once = [(r["user_id"], r["window"]["start"]) for r in mails.select("user_id", "window").collect()]
    assert len(once) == len(set(once)) > 20
    mailed = {i for r in mails.collect() for i in r["ids"]}
    after = ST.with_claims(spark.createDataFrame(rows, kind), f"{tmp_path}/out")
    assert {r["id"] for r in after.collect() if r["emailed"]} == mailed and not any(rows[i][3] for i in mailed)


@pytest.mark.parametrize("when", ["before", "after"])
def test_uploads_are_stored_once(spark, tmp_path, when):
    rows = [(None if k == 9 else f"s{k % 11}", f"f{k}") for k in range(40)]
    stream = as_stream(spark, [spark.createDataFrame(rows[k : k + 10], "sha256 string, file_path string") for k in range(0, 40, 10)], f"{tmp_path}/a")
    with pytest.raises(Exception, match="broken"):
        ST.each_batch(stream, broken(ST.only_new_uploads(f"{tmp_path}/t"), 1, when), f"{tmp_path}/state")
    for checkpoint in ("state", "new"):
        ST.each_batch(stream, ST.only_new_uploads(f"{tmp_path}/t"), f"{tmp_path}/{checkpoint}")
    assert sorted(r["sha256"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == sorted({s for s, _ in rows if s})
