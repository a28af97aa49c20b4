"""Whole-number codebooks and clusters against plain code and SQL; odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenspan.llm import clustering, codebooks
from lumenspan.llm.oracles import ORACLES
from lumenspan.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroid_clustering"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_its_sql(spark, name, sf):
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    got, want = QUERIES[name](spark, f"/root/testdata/{sf}"), duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.select(*names).collect(), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("width,scale", [(16, 100), (16, 1 << 26), (5, 3), (1, 50), (2, 7), (33, 1000)])
def test_bounds_lose_no_nearest_entry(width, scale):
    rng = np.random.default_rng(width)
    x = (rng.normal(size=(500, width)) * scale).clip(-(1 << 27), 1 << 27).astype(np.int64)
    x[100:140], x[300:310] = x[7], 0
    book = codebooks.Levels(np.concatenate([x[:90], x[:90]]))
    apart = ((x[:, None] - book.exact) ** 2).sum(2)
    entry, distance, exact = codebooks.nearest(x, book)
    assert (entry == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert exact <= apart.size
    if width == 16 and scale == 100:
        assert exact < 0.7 * apart.size  # the bounds do filter
    for own, other in zip(codebooks.Levels(x).levels, book.levels, strict=True):
        bound = ((own[:, None] - other) ** 2).sum(2)
        assert (bound <= apart * (1 + 1e-12) + 1e-6).all()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(code, error) of whole-number rows (id, label, vector) and the digest of the codebooks, entry by entry."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(order[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in order[:entries]] for p in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held: dict = {}
            for _, _, v in order:
                held.setdefault(best(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(book)]
    out = []
    for i, label, v in rows:
        found = [best(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    sums: dict = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str((i, code, error, sums[label], digest)) for i, code, error, label in out))


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [None, 1, 2][i % 3], rng.normal(size=8).round(2).tolist()) for i in range(-30, 30)]
    good += [(5, 1, [0.5] * 8), (5, 1, [0.5] * 8), (None, 2, [-1.5] * 8), (None, None, [1.25] * 8), (77, 1, [0.0] * 8), ((1 << 60) + 1, 1, [2.0] * 8)]
    odd = [(1, 1, None), (2, 1, []), (3, 1, [1.0] * 7), (4, 1, [NAN] + [1.0] * 7), (5, 1, [INF] + [1.0] * 7), (6, 2, [None] + [1.0] * 7), (7, 2, [1.0] * 4)]
    df = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<double>")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "code", "error", "bare", "part", "n", "part_")])
    got = codebooks.compress(df, entries=9)
    want = plain_codes([(i, label, [int(np.floor(1024 * x)) for x in v]) for i, label, v in good], entries=9)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codebooks.compress(df.where("embedding is null")).collect() == [] == codebooks.compress(df.limit(0)).collect()
    one = codebooks.compress(df.where("vec_id = 77"), label_col=None).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(77, "00000000", 0, 0)]
    with pytest.raises(PySparkException, match="would not fit"):
        codebooks.compress(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), label_col=None).collect()


def plain_lloyd(rows, k=40, rounds=5):
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    start = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))[:k]
    now = [list(v) for _, v in start]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(now))
    for _ in range(rounds):
        held: dict = {}
        for _, v in rows:
            held.setdefault(best(v)[1], []).append(v)
        now = [[sum(c) // len(c) for c in zip(*held[i], strict=True)] if i in held else c for i, c in enumerate(now)]
    found = [(i, *best(v)) for i, v in rows]
    own: dict = {}
    for _, d, c in found:
        own[c] = own.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(str((i, c, d, own[c], sum(own.values()), digest[c])) for i, d, c in found)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=6).round(2).tolist()) for i in range(-40, 40)]
    good += [(3, [0.5] * 6)] * 3 + [(None, [-1.5] * 6), (None, [1.25] * 6), (900, [0.0] * 6), (901, [0.5] * 6), ((1 << 60) + 1, [2.0] * 6)]
    odd = [(1, None), (2, []), (3, [1.0] * 5), (4, [NAN] + [1.0] * 5), (5, [-INF] + [1.0] * 5), (6, [None] + [1.0] * 5), (7, [1.0] * 7)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "cluster", "distance", "inertia", "n")])
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in good]
    for k in (7, 200):
        got = clustering.lloyd(df, centroids=k, width=6)
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_lloyd(whole, k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.lloyd(df).collect() == [] == clustering.lloyd(df.limit(0), width=6).collect()
    with pytest.raises(PySparkException, match="would not fit"):
        clustering.lloyd(spark.createDataFrame([(1, [1e9] * 6)], "vec_id long, embedding array<double>"), width=6).collect()


def test_an_empty_centroid_stays(spark):
    """All vectors equal: the first centroid takes all, the others keep their place."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = clustering.lloyd(df, centroids=3, width=2).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 9
