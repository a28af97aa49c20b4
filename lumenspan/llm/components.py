"""Connected components of a graph of longs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, release


def _toward_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(node, least, n): the least of a node and its neighbours, and its edges; combines before the shuffle, keeps no neighbour lists."""
    return edges.groupBy(F.col(node).alias(node)).agg(F.least(F.min(other), F.col(node)).alias("least"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = hot_join(both.where("b > a"), _toward_least(both, "a", "b"), ["a"], total, F.xxhash64("b"))
    return met.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    kept = hot_join(edges, _toward_least(edges, "a", "b"), ["a"], total, F.xxhash64("b"))
    moved = kept.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(kept.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the least node reachable.

    Null ends, loops and repeated edges have no effect; without edges the result has no
    rows. Each round is written to the shared folder, so lost executors cost one round.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = materialize(now, name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen, before = tuple(mark), now
        large = materialize(_large_star(now, mark[0]), name)
        now = materialize(_small_star(large, mark[0]), name)
        release(before)
        release(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
