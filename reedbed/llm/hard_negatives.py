"""Hard-negative mining: exact scores of anchors against all rows by the method of the Four Russians.

Vectors are whole numbers. A candidate is kept as bit planes: for each bit of its components, lowest first, one byte for each
eight dimensions. For each anchor and each eight dimensions there is a table of the sums of all 256 subsets of its eight
components, indexed by such a byte. A plane's lookups add up to the anchor's product with that plane; planes are shifted
and added from the highest, whose sign is negative, and give the full inner product.

Anchors are a stated query set against all rows. Both are dealt into blocks of bounded size by hash, and each pair of blocks is
one task's group; it gives out a few rows for each anchor, whatever labels and vectors are common. Positives are found
first; negatives must score within bounds that follow from them, so that candidates are scored a second time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import Workspace

ANCHOR_BLOCK, ROW_BLOCK = 2048, 2048
LANES = 64  # anchors whose tables are looked up side by side
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score that a negative's score lies between


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: q holds floor(scale * x) of each component x.

    Rows with a null id, label, vector or component, or a component that is not finite or beyond what a score can hold
    (2 ** 62 / scale), take no part. Rows that repeat an id are one: the least by (label, vector).
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < 2.0**62 / scale), F.lit(False)))
    held = rows.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))
    return held.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of dims columns, shorter ones filled up with 0."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(lists), dims), np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), within] = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return out


def pack_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Rows of whole numbers in two's complement of bits bits as (rows, bits, dims / 8) bytes; dims is a multiple of 8."""
    return np.stack([np.packbits(((q >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def subset_tables(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """(dims / 8, 256, anchors): for each eight dimensions and each byte, the sum of the components whose bit is set."""
    parts = anchors.T.reshape(-1, 8, len(anchors)).astype(kind)
    out = np.zeros((len(parts), 256, len(anchors)), kind)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, j, None]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors): full inner products of packed rows with the tables' anchors."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    for b in range(bits - 1, -1, -1):
        plane = tables[0][planes[:, b, 0]]
        for g in range(1, groups):
            plane += tables[g][planes[:, b, g]]
        total = -plane if b == bits - 1 else (total << 1) + plane
    return total


def _shape(held: DataFrame) -> tuple[int, int, int]:
    """(bits, dims, largest absolute component) of all vectors; dims is a multiple of 8."""
    low, high, dims = held.agg(F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(F.size("q"))).first()
    low, high = low or 0, high or 0
    return max(high.bit_length(), (-1 - low).bit_length() if low < 0 else 0) + 1, max(8, -(-(dims or 0) // 8) * 8), max(abs(low), abs(high))


def _sides(held: DataFrame, anchors: DataFrame, planes: DataFrame) -> Callable[[Callable, str], DataFrame]:
    """A function that runs another over every pair of a block of anchors and a block of rows."""
    blocks = [max(1, -(-df.count() // size)) for df, size in ((anchors, ANCHOR_BLOCK), (planes, ROW_BLOCK))]
    sides = []
    for df, key, own, other in ((anchors, "anchor_id", 0, 1), (planes, "vec_id", 1, 0)):
        named = df.withColumn(f"b{own}", F.pmod(F.xxhash64(key), F.lit(blocks[own])))
        sides.append(named.withColumn(f"b{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[other] - 1).cast("long")))).groupBy("b0", "b1"))
    return lambda run, kinds: sides[0].cogroup(sides[1]).applyInArrow(run, kinds)


def _block_scores(anchors: pa.Table, rows: pa.Table, bits: int, dims: int, largest: int):
    """Each lane of anchors of a pair of blocks: (numbers of its anchors, scores of all rows for each of them)."""
    own = _matrix(anchors.column("q").combine_chunks(), dims)
    packed = np.frombuffer(b"".join(rows.column("planes").to_pylist()), np.uint8).reshape(rows.num_rows, bits, dims // 8)
    kind = np.int32 if (largest * dims) << bits < 1 << 31 else np.int64
    for s in range(0, len(own), LANES):
        yield np.arange(s, min(s + LANES, len(own))), scores(packed, subset_tables(own[s : s + LANES], kind)).T.astype(np.int64)


def _best_first(score: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those of which by score, highest first; rows lie in order of their ids, so that ties go to smaller ids."""
    return which[np.argsort(-score[which], kind="stable")]


def _positives(bits: int, dims: int, largest: int, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        aid, alabel = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for lane, score in _block_scores(anchors, rows, bits, dims, largest) if anchors.num_rows and rows.num_rows else ():
            for k, own in zip(lane.tolist(), score, strict=True):
                which = np.flatnonzero((labels == alabel[k]) & (ids != aid[k]))
                if len(which) > 4 * count:
                    floor = np.partition(own[which], len(which) - count)[len(which) - count]
                    which = which[own[which] >= floor]
                best = _best_first(own, which)[:count]
                for column, value in zip(out, (np.full(len(best), aid[k]), ids[best], own[best]), strict=True):
                    column.append(value)
        none = np.zeros(0, np.int64)
        return pa.table({n: np.concatenate([none, *c]) for n, c in zip(("anchor_id", "positive_id", "positive_score"), out, strict=True)})

    return run


def _negatives(bits: int, dims: int, largest: int, count: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        aid, alabel, found = anchors.column("anchor_id").to_pylist(), anchors.column("label").to_numpy(), anchors.column("positives").to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in names]
        for lane, score in _block_scores(anchors, rows, bits, dims, largest) if anchors.num_rows and rows.num_rows else ():
            for k, own in zip(lane.tolist(), score, strict=True):
                bounds = [(p["positive_id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in found[k]]
                bounds = [b for b in bounds if b[2] <= b[3]]
                if not bounds:
                    continue
                which = np.flatnonzero((labels != alabel[k]) & (own >= min(b[2] for b in bounds)) & (own <= max(b[3] for b in bounds)))
                order = _best_first(own, which)
                fallen = -own[order]
                for positive, value, least, most in bounds:
                    start = int(np.searchsorted(fallen, -most, "left"))
                    best = order[start : start + count]
                    best = best[own[best] >= least]
                    for column, x in zip(out, (np.full(len(best), aid[k]), np.full(len(best), positive), np.full(len(best), value), ids[best], own[best]), strict=True):
                        column.append(x)
        none = np.zeros(0, np.int64)
        return pa.table({n: np.concatenate([none, *c]) for n, c in zip(names, out, strict=True)})

    return run


def mine_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id, label, q as quantised gives them; anchors: vec_id of those rows that are anchors. A score is the inner product
    of two rows' q, of which a shorter one is filled up with 0; it must fit in a long. Higher scores come first, ties by
    smaller vec_id. An anchor's positives are its first rows of the same label, itself left out; a positive's negatives are
    its first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1.
    Pairs without negatives have no row; ids in anchors that are no rows are left out. An empty table gives an empty table.
    """
    space = Workspace(rows.sparkSession, "hard-negatives")
    held = space.keep(rows, "rows")
    bits, dims, largest = _shape(held)

    def pack(batches):
        for batch in batches:
            planes = pack_planes(_matrix(batch.column(2), dims), bits).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in planes], pa.binary())], ["vec_id", "label", "planes"])

    planes = space.keep(held.mapInArrow(pack, "vec_id long, label long, planes binary"), "planes")
    queries = space.keep(held.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").withColumnRenamed("vec_id", "anchor_id"), "anchors")
    found = _sides(held, queries, planes)(_positives(bits, dims, largest, positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("place", place).filter(F.col("place") <= positives)
    found = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", F.col("positive_score").alias("score"))).alias("positives"))
    asked = space.keep(queries.join(found, "anchor_id"), "asked")
    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = _sides(held, asked, planes)(_negatives(bits, dims, largest, negatives, low, high), kinds)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return mined.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, every: int = 50, moved: int = 7, labels: int = 10) -> DataFrame:
    """The rows of mine_negatives for the query: anchors are the rows whose vec_id is divisible by every; where it is
    divisible by moved, label first becomes (label + 1) % labels. Nulls, repeats and empty tables as in quantised and
    mine_negatives; other columns are ignored."""
    rows = quantised(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine_negatives(rows, rows.filter(F.col("vec_id") % every == 0))
