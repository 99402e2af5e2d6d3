"""Operational logs: statements and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify_statement

MINUTE = pd.Timedelta(minutes=1)


def with_class(log: DataFrame) -> DataFrame:
    operation, table = classify_statement("statement")
    return log.withColumn("operation", operation).withColumn("table", table)


def statement_metrics(log: DataFrame) -> DataFrame:
    """Per (operation, table): count, total, mean and longest milliseconds, to two places; most total time first."""
    own = with_class(log).groupBy("operation", "table").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 2).alias("total_ms"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.round(F.max("ms"), 2).alias("max_ms"))
    return own.orderBy(F.desc("total_ms"), "operation", "table")


def statement_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"), F.round(F.sum("ms"), 2).alias("total_ms"))


def slowest_statements(log: DataFrame, k: int = 10) -> DataFrame:
    """The k slowest statements, cut to 300 characters; the earlier first on ties."""
    return log.orderBy(F.desc("ms"), "at", "id").limit(k).select("id", F.substring("statement", 1, 300).alias("statement"), F.round("ms", 2).alias("ms"), "at")


def live_sessions(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions that are not revoked, of readers who are not erased."""
    return tokens.filter("revoked_at is null").join(users.filter("not is_deleted").select(F.col("id").alias("user_id")), "user_id", "left_semi")


def revoke_sessions(tokens: DataFrame, revoked: DataFrame) -> DataFrame:
    """tokens after revocations (token, ts): only rows not revoked yet are stamped, by the earliest."""
    first = revoked.groupBy("token").agg(F.min("ts").alias("__ts"))
    return tokens.join(first, "token", "left").withColumn("revoked_at", F.coalesce("revoked_at", "__ts")).select(*tokens.columns)


def kept_uses(last: pd.Timestamp | None, revoked: bool, times: Iterator, revokes: Iterator) -> tuple[list[bool], pd.Timestamp | None, bool]:
    """Which requests move the last use: a minute or more after the last one that did; none from a revocation on."""
    out = []
    for t, r in zip(times, revokes, strict=True):
        revoked = revoked or bool(r)
        keep = not revoked and (last is None or t - last >= MINUTE)
        last = t if keep else last
        out.append(keep)
    return out, last, revoked


def session_activity(requests: DataFrame) -> DataFrame:
    """(token, id, ts) of requests that move last_used_at. requests: id, token, ts, revokes.

    Greedy: whether a row counts depends on the last one that did, so a token's rows are read in order by one helper call.
    """

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"])
        keep, _, _ = kept_uses(None, False, iter(pdf["ts"]), iter(pdf["revokes"]))
        return pdf[keep][["token", "id", "ts"]]

    return requests.groupBy("token").applyInPandas(thin, f"token {requests.schema['token'].dataType.simpleString()}, id long, ts {requests.schema['ts'].dataType.simpleString()}")
