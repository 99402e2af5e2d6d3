"""Places and running totals of a whole table in a given order, without bringing its rows to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: list[Column], path: str, totals: dict[str, Column | None]) -> DataFrame:
    """df with one long column for each of totals: the sum of its value over all rows before this one in the order; None
    counts rows, so that it gives the row's place from 0.

    Rows are dealt into ranges of the order and sorted there; each range sums its own rows, and the sums of the ranges before
    it are added, of which there are as many as ranges. Rows that are equal in the order come in any order, and stay in one
    range: end the order with a column that tells them apart where very many rows may be equal. The ranges are written under
    path, so that all later reads see one dealing. Null values count as 0. df must not have columns named as totals,
    __part or __v0, __v1 and so on; all other columns stay as they are. An empty table gives an empty table.
    """
    names = list(totals)
    own = [f"__v{k}" for k in range(len(names))]
    valued = df.withColumns({v: F.coalesce(F.lit(1) if totals[n] is None else totals[n], F.lit(0)).cast("long") for v, n in zip(own, names, strict=True)})
    ranged = valued.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = [*valued.columns, *names, "__part"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in valued.schema.fields) + "".join(f", `{n}` long" for n in names) + ", __part int"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), [0] * len(own)
        first = len(valued_names) - len(own)
        for batch in batches:
            before = []
            for k in range(len(own)):
                value = batch.column(first + k).to_numpy(zero_copy_only=False)
                upto = np.cumsum(value) + sums[k]
                before.append(pa.array(upto - value, pa.int64()))
                sums[k] = int(upto[-1]) if len(upto) else sums[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(batch.num_rows, part, np.int32))], columns)

    valued_names = valued.columns
    ranged.mapInArrow(add, kinds).write.parquet(path)
    spark = df.sparkSession
    held = spark.read.parquet(path)
    ends = held.groupBy("__part").agg(*(F.sum(v).alias(v) for v in own))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select(F.col("__part"), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__o{k}") for k, v in enumerate(own)))
    placed = held.join(F.broadcast(offsets), "__part")
    return placed.select(*df.columns, *((F.col(n) + F.col(f"__o{k}")).alias(n) for k, n in enumerate(names)))
