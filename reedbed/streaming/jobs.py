"""Structured Streaming: fan-out, digests, seminar state, last uses, statement metrics, upload de-duplication."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import classify_statement
from ..operators.inbox import mails
from ..operators.ops import kept_uses
from ..operators.seminars import FOLDED, SeminarState, fold_rows, folded_frame


def stream_notifications(events: DataFrame, readers: DataFrame) -> DataFrame:
    """Each event for each reader of its paper, as it arrives: a join of the stream with a table.

    events: paper_key, seq, actor_id, content. readers: paper_key, user_id.
    """
    return events.join(readers, "paper_key").filter("user_id <> actor_id").select("user_id", "seq", "content")


def stream_digest(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, window, ids, email, n, subject, body): the mail of each day that ends at 21:00; a row a day late is never mailed.

    created_at must be a timestamp with time zone. A closed window is emitted once; ids are its notifications, in order. users is a
    table that the stream meets. Run it through mail_once, so that nothing is mailed twice.
    """
    rows = notifications.filter("not read and not emailed").withWatermark("created_at", "1 day")
    own = F.sort_array(F.collect_list(F.struct("created_at", "id", "content"))).alias("own")
    days = rows.groupBy("user_id", F.window("created_at", "1 day", startTime="21 hours")).agg(F.count("*").alias("n"), own)
    return mails(days.withColumn("ids", F.transform("own", lambda x: x["id"])), users)


def _in_time(state: GroupState, waiting: list[str], rows: pd.DataFrame, upto: int) -> tuple[list[dict], list[str], int]:
    """(ready, still waiting, upto): the events of one key whose time the watermark has passed, in order, and those that wait.

    An event is kept until the watermark, which trails the latest event by the delay, has reached its time: nothing that is
    in time can come before it any more. Rows at or before the watermark of the last call are late and dropped.
    """
    mark = max(state.getCurrentWatermarkMs() * 1000, upto)
    held = [json.loads(w) for w in waiting]
    for r in rows.to_dict("records"):
        at = int(pd.Timestamp(r["at"]).value // 1000)
        if at > upto:
            held.append({k: _plain(v) for k, v in r.items() if k != "at"} | {"at": at})
    ready = sorted((h for h in held if h["at"] <= mark), key=lambda h: (h["at"], h["seq"]))
    left = [h for h in held if h["at"] > mark]
    if left:
        soon = min(h["at"] for h in left) // 1000
        state.setTimeoutTimestamp(max(soon - 1, state.getCurrentWatermarkMs() + 1))
    return ready, [json.dumps(h) for h in left], mark


def _plain(v: object) -> object:
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    return v.item() if hasattr(v, "item") else str(v) if isinstance(v, pd.Timestamp) else v


class _Event:
    """The fields of a waiting event as attributes."""

    def __init__(self, fields: dict):
        self.__dict__.update(fields)


def stream_seminar_state(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """seminar_fold as state for each paper, for events that arrive in any order up to delay late.

    ts must be a timestamp with time zone. Each event waits until the watermark has passed its time, and is then applied after
    all earlier ones of its paper; one that comes later than that is dropped. Events of the last delay wait for the
    stream to go on.
    """
    kinds = "room int, status string, leader long, members array<long>, upto long, waiting array<string>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (0, "none", None, [], -(1 << 62), [])
        own = SeminarState(kept[0], kept[1], kept[2], tuple(kept[3] or ()))
        rows = pd.concat([f.assign(at=f["ts"]).drop(columns="ts") for f in frames] or [pd.DataFrame(columns=["at"])])
        ready, waiting, upto = _in_time(state, list(kept[5] or ()), rows, kept[4])
        out = fold_rows(own, key[0], iter([_Event(r) for r in ready]))
        state.update((own.room, own.status, own.leader, own.members, upto, waiting))
        if out:
            yield folded_frame(out)

    return events.withWatermark("ts", delay).groupBy("paper_key").applyInPandasWithState(step, FOLDED, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def stream_last_used(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """session_activity as state for each token, for requests that arrive in any order up to delay late: the last kept use,
    whether the token is revoked, and the requests that wait for the watermark. ts must be a timestamp with time zone."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    held = "last long, revoked boolean, upto long, waiting array<string>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, revoked, upto, waiting = state.get if state.exists else (None, False, -(1 << 62), [])
        rows = pd.concat([f.assign(at=f["ts"], seq=f["id"])[["at", "seq", "revokes"]] for f in frames] or [pd.DataFrame(columns=["at"])])
        ready, waiting, upto = _in_time(state, list(waiting or ()), rows, upto)
        at = [pd.Timestamp(r["at"], unit="us", tz="UTC") for r in ready]
        keep, last, revoked = kept_uses(None if last is None else pd.Timestamp(last, unit="us", tz="UTC"), revoked, iter(at), (r["revokes"] for r in ready))
        state.update((None if last is None else last.value // 1000, revoked, upto, waiting))
        some = [(r["seq"], t) for r, t, k in zip(ready, at, keep, strict=True) if k]
        if some:
            yield pd.DataFrame({"token": pd.Series([key[0]] * len(some), dtype=object), "id": pd.Series([x[0] for x in some], dtype="int64"), "ts": pd.Series([x[1] for x in some], dtype="datetime64[us, UTC]")})

    return requests.withWatermark("ts", delay).groupBy("token").applyInPandasWithState(step, f"token {kinds['token']}, id long, ts timestamp", held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_statement_metrics(log: DataFrame) -> DataFrame:
    """statement_metrics continuously: run it in update mode, with into_keyed_table, so that a batch gives out only what it changed."""
    operation, table = classify_statement("statement")
    rows = log.withColumn("operation", operation).withColumn("table", table)
    return rows.groupBy("operation", "table").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 2).alias("total_ms"), F.round(F.max("ms"), 2).alias("max_ms"))


def stream_upload_dedup(uploads: DataFrame, replay: str) -> DataFrame:
    """Equal bytes once within a replay window of event time ts; without such a bound, see only_new_uploads."""
    return uploads.withWatermark("ts", replay).dropDuplicatesWithinWatermark(["sha256"])


def _run_of(batch: DataFrame) -> str:
    """The id of the running query, which stays the same when it is started again from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of parts by run and batch, empty as long as nothing is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    full = f"{schema}, run string, batch long"
    return spark.read.schema(full).parquet(path) if there else spark.createDataFrame([], full)


def _store(df: DataFrame, path: str, run: str, batch: int) -> None:
    """Write df as the part of a run and batch, in place of what a broken try of the same batch left there."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")


def into_keyed_table(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for update mode: each row replaces the table's partition of its keys, so that a batch that is run
    again leaves the same table. Meant for few keys; nothing of the table is read or kept in the driver."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    return write


def only_new_uploads(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of uploads (sha256, file_path), the least path of each digest that no other batch has stored is
    added to the table under path. The table is the memory: no state is kept, and a replay from a new checkpoint adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        run = _run_of(batch)
        others = _stored(batch.sparkSession, path, "sha256 string, file_path string").filter(~((F.col("run") == run) & (F.col("batch") == number)))
        one = batch.filter("sha256 is not null").groupBy("sha256").agg(F.min("file_path").alias("file_path"))
        _store(one.join(others.select("sha256"), "sha256", "left_anti"), path, run, number)

    return write


def mail_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over stream_digest: each notification is mailed at most once, whatever is started again.

    A batch first claims its windows (path/claims: user_id, id of each notification), those aside that another run or batch
    has claimed, and then adds the mails of what it claimed (path/mails). A batch that broke off is run again under its own
    number, and replaces its claims and mails. with_claims puts the flags of exactly the claimed rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        run, spark = _run_of(batch), batch.sparkSession
        others = _stored(spark, f"{path}/claims", "user_id long, id long").filter(~((F.col("run") == run) & (F.col("batch") == number)))
        each = batch.select("user_id", "window", F.explode("ids").alias("id"))
        taken = each.join(others.select("user_id", "id"), ["user_id", "id"], "left_semi").select("user_id", "window").distinct()
        fresh = batch.join(taken, ["user_id", "window"], "left_anti")
        _store(fresh.select(F.col("user_id").cast("long"), F.explode("ids").alias("id")), f"{path}/claims", run, number)
        _store(fresh, f"{path}/mails", run, number)

    return write


def with_claims(notifications: DataFrame, path: str) -> DataFrame:
    """notifications with emailed set for the rows that mail_once claimed under path."""
    claimed = _stored(notifications.sparkSession, f"{path}/claims", "user_id long, id long").select("id", F.lit(True).alias("__sent")).distinct()
    return notifications.join(claimed, "id", "left").withColumn("emailed", F.col("emailed") | F.col("__sent").isNotNull()).select(*notifications.columns)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is, each batch through write."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is, and read what it appended."""
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
