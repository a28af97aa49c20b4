"""Exact percentiles by refined ranges, and masked means, against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import dense as D
from lumenspan.operators import logs as L


@pytest.mark.parametrize("ranges", [2, 256])
def test_percentiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(L, "RANGES", ranges)
    rng = random.Random(3)
    groups = {"a": [rng.expovariate(0.01) for _ in range(700)], "b": [1.0] * 50, "c": [5.0, -3.0], None: [float(2**k) for k in range(-20, 20)] * 2, "e": [rng.randrange(9) * 1.0 for _ in range(300)] + [1e12]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    got = {r["ext"]: r for r in L.percentiles(spark.createDataFrame(rows, "ext string, ms double"), ["ext"], [0, 50, 95, 100]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        own = sorted(vs)
        for p in (0, 50, 95, 100):
            assert got[g][f"p{p}"] == own[min(len(own) * p // 100, len(own) - 1)], (g, p)
        assert got[g]["n"] == len(own) and got[g]["max_ms"] == own[-1] and got[g]["total_ms"] == pytest.approx(sum(own))
    assert L.percentiles(spark.createDataFrame([], "ext string, ms double"), ["ext"], [50]).collect() == []


def test_pooled(spark):
    rows = [("a", [3.0, 0.0], 1), ("a", [1.0, 8.0], 1), ("a", [100.0, 100.0], 0), ("b", [1.0, 1.0], 0), ("c", [1.0, 1.0], None), ("d", [2.0, 0.0], 1), ("d", [-2.0, 0.0], 5)]
    got = {r["k"]: (r["vector"], r["n"]) for r in D.pooled(spark.createDataFrame(rows, "k string, embedding array<float>, mask int"), "k").collect()}
    length = math.hypot(2, 4)
    assert got["a"] == (pytest.approx([2 / length, 4 / length]), 2)
    assert got["b"] == ([0.0, 0.0], 0) == got["c"] and got["d"] == ([0.0, 0.0], 2)
    assert D.pooled(spark.createDataFrame([], "k string, embedding array<float>, mask int"), "k").where(F.col("n") > 0).collect() == []
