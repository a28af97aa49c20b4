"""Vectors as whole numbers, for the operators whose arithmetic is exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest size of a scaled component; squared distances of up to 64 such components fit in a long.
LARGEST = 1 << 27


def finite(column: str):
    """True for vectors that are not null and hold neither null nor non-finite components."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(fine, F.lit(False))


def floored(column: str, scale: int):
    """Each component x as the integer floor(scale * x), x as double; a component too large for exact distances is an error."""
    scaled = F.transform(column, lambda x: x.cast("double") * F.lit(float(scale)))
    large = F.exists(scaled, lambda x: F.abs(x) > F.lit(float(LARGEST)))
    message = F.lit(f"a component of {column} times {scale} is beyond {LARGEST}; distances would not fit in a long")
    return F.when(large, F.raise_error(message).cast("array<int>")).otherwise(F.transform(scaled, lambda x: F.floor(x).cast("int")))


def exact_means(partial: DataFrame, keys: list[str]) -> dict[tuple, list[int]]:
    """The floor(sum / count) of each component, by key, from rows (keys, n, sums) of all partitions.

    As many rows come back as the keys have components. More vectors than a long can add
    up are an error.
    """
    parts = partial.select(*keys, "n", F.posexplode("sums").alias("at_", "sum_"))
    out: dict[tuple, dict[int, int]] = {}
    for row in parts.groupBy(*keys, "at_").agg(F.sum("n").alias("n"), F.sum("sum_").alias("sum")).collect():
        if row["n"] > (1 << 63) // LARGEST - 1:
            raise OverflowError(f"sums of {row['n']} vectors may not fit in a long")
        out.setdefault(tuple(row[k] for k in keys), {})[row["at_"]] = row["sum"] // row["n"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix of longs."""
    return np.stack(column.to_numpy()).astype(np.int64)
