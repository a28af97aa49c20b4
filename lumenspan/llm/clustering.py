"""Centroid clustering by plain Lloyd rounds over whole numbers.

The few centroids are broadcast. Each task computes the integer squared differences of
its rows to every centroid, takes the nearest, and adds its rows up by centroid; these sums,
a row a task and centroid, merge in one grouping. No vector is shuffled in any round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import exact_means, finite, floored, matrix

CENTROIDS, ROUNDS, SCALE, WIDTH = 40, 5, 256, 64
#: Rows whose differences to a centroid are in memory at a time.
ROWS = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties go to the smaller number."""
    at, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for low in range(0, len(x), ROWS):
        rows = x[low : low + ROWS]
        squares = np.empty((len(rows), len(centroids)), np.int64)
        for c, centroid in enumerate(centroids):
            apart = rows - centroid
            squares[:, c] = (apart * apart).sum(1)
        own = squares.argmin(1)
        at[low : low + ROWS], distance[low : low + ROWS] = own, squares[np.arange(len(rows)), own]
    return at, distance


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = "2:") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): every kept vector's cluster.

    Kept are vectors of exactly ``width`` components, none null or non-finite; each component
    x becomes floor(scale * x). The starting centroids are the kept vectors with the smallest
    sha256 of ``seed`` and the id in decimal. Rows that repeat an id are one vector each; of
    equal hashes the smaller vector comes first, rows without id come last. With fewer
    vectors than ``centroids`` there are as many clusters as vectors; without any the
    result has no rows. Equal vectors share a cluster, ties go to the smaller number, a
    centroid without vectors stays. Components beyond ``vectors.LARGEST`` after scaling
    are an error. Other columns are ignored.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    usable = vectors.where(finite(vector_col) & (F.size(vector_col) == width))
    kept = materialize(usable.select(F.col(id_col).alias("id"), floored(vector_col, scale).alias("v")), "whole")
    name = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "v").limit(centroids).select("v").collect()
    out_schema = f"`{id_col}` {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out_schema)
    now = np.array([r["v"] for r in first], np.int64)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(now)

        def add_up(batches, sent=sent):
            there = sent.value
            counts, sums = np.zeros(len(there), np.int64), np.zeros(there.shape, np.int64)
            for batch in batches:
                if len(batch):
                    x = matrix(batch["v"])
                    at, _ = nearest(x, there)
                    counts += np.bincount(at, minlength=len(there))
                    for c in np.unique(at):
                        sums[c] += x[at == c].sum(0)
            held = np.flatnonzero(counts)
            if len(held):
                yield pd.DataFrame({"cluster": held.astype(np.int32), "n": counts[held], "sums": list(sums[held])})

        moved = exact_means(kept.select("v").mapInPandas(add_up, "cluster int, n long, sums array<long>"), ["cluster"])
        now = now.copy()
        for (c,), mean in moved.items():
            now[c] = mean
        sent.unpersist()

    sent = spark.sparkContext.broadcast(now)

    def assign(batches):
        for batch in batches:
            if len(batch):
                at, distance = nearest(matrix(batch["v"]), sent.value)
                yield pd.DataFrame({"id": batch["id"], "cluster": at.astype(np.int32), "distance": distance})

    # Ids travel as text, since pandas would turn whole numbers beside nulls into doubles.
    assigned = materialize(kept.select(F.col("id").cast("string"), "v").mapInPandas(assign, "id string, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    told = spark.createDataFrame([(c, own, sum(inertia.values()), digest[c]) for c, own in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
