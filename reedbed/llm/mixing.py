"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then a seeded choice of blocks.

1. Sources get targets by weight; a target stops at a multiple of its source's size, and the excess is shared again.
2. Every source's words, its documents one after the other, are cut into blocks of equal length. The mix has as many blocks as
   its words fill. They go to sources by the highest quotients target / (2 k + 1), k being the blocks a source has already:
   a source has all its quotients above a common bound, so the bound is searched and no list of quotients is sorted.
3. A source's blocks go to its shards, runs of a fixed number of blocks, by the same rule. All shards but the last are equal, so
   each shard's quota follows from the source's row alone.
4. In a shard every block is taken as often as the quota fills it; the rest goes to its blocks of least seeded hash.

Documents travel as ids and sizes. A hot source only has more shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import running_totals
from .store import Workspace
from .textbatch import mix

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 150  # per cent of all words that the mix has
WEIGHTS = (3, 1, 2)
MOST = 2  # times that a word is taken at most
BLOCK_WORDS = 16
SHARD_BLOCKS = 4096
SEED = 20240611
SALTS = 16  # parts that the documents of a source are dealt into when they meet its row
TRIES = 64  # bounds that one pass over the sources counts


def share_out(sources: DataFrame, share: int, most: int) -> tuple[int, int]:
    """(numerator, denominator) of the words per unit of weight: targets above most times the size stop there, and what they
    leave is shared by weight again until none is above. sources: size, weight."""
    wide = "decimal(38,0)"
    limit = F.col("size").cast(wide) * most
    whole = int(sources.agg(F.sum("size")).first()[0] or 0) * share
    num, den, seen = 0, 1, -1
    while True:
        over = limit * F.lit(den).cast(wide) < F.lit(num).cast(wide) * F.col("weight")
        n, full, weight = sources.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == seen or not weight:
            return num, den
        num, den, seen = whole - 100 * int(full or 0), 100 * int(weight), n


def _seats(votes: Column, bound: Column | float, limit: Column) -> Column:
    """How many quotients votes / (2 k + 1) are at least half of bound, limit at most."""
    return F.least(limit, F.floor(votes / bound + F.lit(0.5))).cast("long")


def apportion(parties: DataFrame, seats: int, order: Column, space: Workspace) -> DataFrame:
    """parties (votes double, limit long, other columns) with seats: seats in all, to the highest quotients
    votes / (2 k + 1); a party stops at its limit. Equal quotients go by order, which tells parties apart.

    A pass counts the seats of many bounds at once, so that a few passes find the bound. Where quotients tie at it, parties
    that tie are numbered. No votes, no seat; fewer seats are given where the limits are met.
    """
    low_vote, high_vote, most = parties.filter("votes > 0 and limit > 0").agg(F.min("votes"), F.max("votes"), F.max("limit")).first()
    if low_vote is None or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    low, high, high_sum = low_vote / (2 * most + 1), high_vote * 4, 0
    if int(parties.agg(F.sum(_seats(F.col("votes"), F.lit(low), F.col("limit")))).first()[0]) <= seats:
        return parties.withColumn("seats", F.when(F.col("votes") > 0, F.col("limit")).otherwise(0).cast("long"))
    while high_sum < seats:
        tries = sorted({low, high, *np.geomspace(low, high, TRIES).tolist()})
        inner = [x for x in tries if low < x < high]
        if not inner:
            break
        sums = parties.agg(*(F.sum(_seats(F.col("votes"), F.lit(x), F.col("limit"))).alias(f"s{k}") for k, x in enumerate(inner))).first()
        good = [(x, int(n)) for x, n in zip(inner, sums, strict=True) if int(n) <= seats]
        high, high_sum = good[0] if good else (high, high_sum)
        low = max((x for x, n in zip(inner, sums, strict=True) if int(n) > seats), default=low)
    least, less = _seats(F.col("votes"), F.lit(low), F.col("limit")), _seats(F.col("votes"), F.lit(high), F.col("limit"))
    if high_sum == seats:
        return parties.withColumn("seats", less)
    ties = running_totals(parties.withColumn("__more", least - less).filter("__more > 0"), [order], space.path("ties"), {"__taken": F.col("__more")})
    tied = ties.select(*parties.columns, F.greatest(F.lit(0), F.least(F.col("__more"), F.lit(seats - high_sum) - F.col("__taken"))).alias("__more"))
    return parties.filter(least <= less).withColumn("seats", less).unionByName(tied.withColumn("seats", (less + F.col("__more")).cast("long")).drop("__more"))


def shard_quota(shard: Column, blocks: Column, seats: Column, shard_blocks: int, most: int) -> Column:
    """The blocks that a shard gets of its source's seats by the highest quotients blocks / (2 k + 1), earlier shards first.

    Full shards have equal quotients; the last one, shorter, has its k-th while those above it leave a seat. The number of its
    seats lies next to its exact share.
    """
    full, rest = F.floor(blocks / shard_blocks).cast("long"), (blocks % shard_blocks).cast("long")
    near = F.greatest(F.lit(0), F.floor(seats.cast("double") * rest / blocks) - 2).cast("long")

    def has(k: Column) -> Column:
        above = F.floor((F.lit(shard_blocks) * (2 * k + 1) + rest) / (2 * rest))
        return ((k + full * above) < seats).cast("long")

    last = near + has(near) + has(near + 1) + has(near + 2) + has(near + 3) + has(near + 4)
    last = F.greatest(F.least(last, most * rest, seats), seats - most * shard_blocks * full)
    last = F.when((rest == 0) | (seats == 0), 0).otherwise(last).cast("long")
    each = seats - last
    return F.when(shard == full, last).otherwise(F.floor(each / full).cast("long") + (shard < each % full).cast("long")).cast("long")


def _source_plan(sized: DataFrame, space: Workspace, share: int, weights: tuple[int, ...], most: int, block_words: int) -> DataFrame:
    """(source, no, source_size, start, target, blocks, seats) of sized (row, doc_id, source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"))
    sources = running_totals(sources, [F.col("source").asc_nulls_last()], space.path("sources"), {"no": None, "start": F.col("size")})
    turn = F.array(*(F.lit(w) for w in weights))
    sources = sources.withColumn("weight", F.get(turn, (F.col("no") % len(weights)).cast("int")))
    num, den = share_out(sources, share, most)
    target = F.least((F.lit(float(num)) * F.col("weight")) / F.lit(float(den)), F.col("size") * F.lit(float(most)))
    sources = space.keep(sources.select("source", "no", "start", "size", target.alias("target"), F.ceil(F.col("size") / block_words).cast("long").alias("blocks")), "targets")
    words = float(sources.agg(F.sum("target")).first()[0] or 0)
    parties = sources.withColumns({"votes": F.col("target"), "limit": F.col("blocks") * most})
    given = apportion(parties, int(words / block_words + 0.5), F.col("no"), space)
    return space.keep(given.select("source", "no", F.col("size").alias("source_size"), "start", "target", "blocks", "seats"), "plan")


def chosen_blocks(no: int, shard: int, blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block of a shard is taken."""
    base, extra = divmod(quota, blocks) if blocks else (0, 0)
    key = mix(np.arange(blocks, dtype=np.uint64) + np.uint64((shard * SHARD_BLOCKS * 7 + 1) % (1 << 63)), seed + no)
    times = np.full(blocks, base, np.int64)
    times[np.argsort(key, kind="stable")[:extra]] += 1
    return times


def mixed_spans(docs: DataFrame, share: int = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, spans), one row per row of docs; spans is an array of (start, end,
    times): the runs of the document's words, counted from 0, that the mix takes, and how often.

    Words are runs of characters outside \\x20 and \\x09-\\x0D; null and empty texts have size 0 and take nothing. Sources
    in code-point order, null last, have the weights in turn; share per cent of all words are shared by weight, and a
    target stops at most times its source's size. Rows that repeat an id are documents of their own; null ids come first.
    Which of several rows of one source, id and size takes which words is open, so that results agree between runs. Other columns
    are ignored. An empty table gives an empty table.
    """
    space = Workspace(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = space.keep(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = _source_plan(sized, space, share, weights, most, block_words)
    parts = plan.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = sized.join(parts, F.col("source").eqNullSafe(F.col("__source")) & (F.pmod("row", F.lit(SALTS)) == F.col("__salt"))).drop("__source", "__salt")
    placed = running_totals(met, [F.col("no"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("row")], space.path("placed"), {"before": F.col("size")})
    first = F.col("before") - F.col("start")
    shard_words = SHARD_BLOCKS * block_words
    low, high = F.floor(first / shard_words), F.floor((first + F.greatest(F.col("size"), F.lit(1)) - 1) / shard_words)
    pieces = placed.withColumn("first", first).withColumn("shard", F.explode(F.sequence(low, high)))
    in_shard = F.least(F.lit(SHARD_BLOCKS), F.col("blocks") - F.col("shard") * SHARD_BLOCKS)
    quota = shard_quota(F.col("shard"), F.col("blocks"), F.col("seats"), SHARD_BLOCKS, most)
    a, b = F.greatest(F.col("first"), F.col("shard") * shard_words), F.least(F.col("first") + F.col("size"), (F.col("shard") + 1) * shard_words)
    keys = ["row", "doc_id", "source", "size", "source_size", "target"]
    pieces = pieces.select(*keys, "no", "shard", in_shard.cast("long").alias("blocks"), F.when(F.col("size") > 0, quota).otherwise(0).alias("quota"), (a - F.col("shard") * shard_words).alias("a"), (b - F.col("shard") * shard_words).alias("b"), (a - F.col("first")).alias("at"))
    spans = "array<struct<start:long,end:long,times:long>>"
    kinds = f"row long, doc_id {dict(placed.dtypes)['doc_id']}, source string, size long, source_size long, target double, shard long, taken long, spans {spans}"
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("times", pa.int64())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times = None, np.zeros(0, np.int64)
        for batch in batches:
            no, shard, blocks, quota_, a_, b_, at = (batch.column(k).to_pylist() for k in range(6, 13))
            taken, runs = [], []
            for k in range(batch.num_rows):
                own: list[dict] = []
                if b_[k] > a_[k]:
                    if key != (no[k], shard[k]):
                        key = (no[k], shard[k])
                        times = chosen_blocks(no[k], shard[k], blocks[k], quota_[k], seed)
                    lo, hi = a_[k] // block_words, -(-b_[k] // block_words)
                    held = times[lo:hi]
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [hi - lo]])
                    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        if held[s]:
                            start, end = max(a_[k], (lo + s) * block_words), min(b_[k], (lo + e) * block_words)
                            own.append({"start": start - a_[k] + at[k], "end": end - a_[k] + at[k], "times": int(held[s])})
                runs.append(own)
                taken.append(sum((x["end"] - x["start"]) * x["times"] for x in own))
            columns = [*(batch.column(k) for k in range(6)), batch.column(7), pa.array(taken, pa.int64()), pa.array(runs, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "shard", "taken", "spans"])

    found = pieces.mapInArrow(take, kinds)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "spans"))), lambda x: x["spans"]))
    return found.groupBy("row").agg(*(F.first(c).alias(c) for c in keys[1:]), F.sum("taken").alias("taken"), joined.alias("spans")).drop("row")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, start, copy, text): the mix itself, one row for each time that a run of words is taken; words are joined by
    single spaces. docs must have one row an id; its rules are those of mixed_spans."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    spans = mixed_spans(docs, **options).select("doc_id", "source", F.explode("spans").alias("s")).select("doc_id", "source", "s.start", "s.end", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.times"))).alias("copy"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0)).alias("words"))
    run = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), " ")
    return spans.join(texts, "doc_id").select("doc_id", "source", "start", "copy", run.alias("text"))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for the query; nulls, repeats and empty tables as in mixed_spans."""
    return mixed_spans(docs).select("doc_id", "size", "source_size", "target", "taken")
