"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def connected_components(links: DataFrame, space: Workspace, rounds: int = 60) -> DataFrame:
    """(a, b) links of any ids -> (id, component): the smallest id reachable, for every id that has a link.

    Alternating large and small stars: each step is a grouped minimum, which Spark combines before its shuffle, and a
    join. Raises if the stars are not stable after the given rounds. An empty table gives an empty table.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.join(least, "u")
        if large:
            return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m"))).filter("a <> b").distinct()

    def digest(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = space.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = digest(edges)
    for _ in range(rounds):
        edges = space.keep(star(star(edges, True), False), "stars")
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components are not stable")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
