"""Near-duplicates and line dedup against brute force, on data with copies, clusters, ties and odd rows."""

import itertools
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import linededup, simhash
from lumenspan.llm.common import read
from lumenspan.llm.components import components


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(fps):
    a = np.array(fps, np.uint64)
    return plain_components([(i, j) for i in range(len(a)) for j in range(i) if bin(int(a[i] ^ a[j])).count("1") <= 3], range(len(a)))


@pytest.mark.parametrize("kind", ["random", "cluster", "chain", "wide"])
def test_links_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    seed = rng.getrandbits(64)

    def flip(x, n):
        for b in rng.sample(range(64), n):
            x ^= 1 << b
        return x

    if kind == "random":
        fps = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1, 1 << 63, 7]
    elif kind == "cluster":  # a large group around one value, at distances that link only some of its pairs
        fps = [flip(seed, rng.choice([0, 1, 2, 3, 4, 5])) for _ in range(900)]
    elif kind == "chain":
        fps = [seed]
        for _ in range(250):
            fps.append(flip(fps[-1], 3))
    else:  # buckets in which nothing links: equal low bits, all else random
        fps = [(rng.getrandbits(40) << 24) | (seed & 0xFFFFFF) for _ in range(400)] + [flip(seed, 2) for _ in range(40)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges, found = simhash.links(df)
    for a, b in edges.limit(50).collect():
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in found.collect()}
    want = brute(fps)
    groups = lambda of: {frozenset(m) for m in of.values()}
    a, b = {}, {}
    for i, f in enumerate(fps):
        a.setdefault(got.get(f, f), set()).add(f)
        b.setdefault(want[i], set()).add(f)
    assert groups(a) == groups(b)


def test_thresholds():
    costs = np.array([[0, 5, 12, 99], [0, 5, 12, 99], [0, 5, 12, 99], [0, 50, 60, 99]], float)
    costs = np.hstack([costs, np.full((4, 1), 200)])
    total, got = simhash.allocate(costs, 3)
    assert total == costs[range(4), [t + 1 for t in got]].sum()
    assert sum(got) == 0 and got[3] == -1 and sorted(got[:3]) == [0, 0, 1]
    together = np.full((64, 64), 25)
    np.fill_diagonal(together, 50)
    together[3, 40] = together[40, 3] = 50
    groups = simhash.correlated_groups(together, 100, 4)
    assert sorted(sum(groups, [])) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({3, 40} <= set(g) for g in groups)


def test_meetings_are_pairs_of_values():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << simhash.WIDTH, 300)
    values[:120] &= 7
    met = simhash.meetings(np.bincount(values, minlength=1 << simhash.WIDTH))
    want = np.bincount((values[:, None] ^ values[None]).ravel(), minlength=1 << simhash.WIDTH)
    assert (met == want).all()
    # Buckets with t bits left out, by looking at all of them.
    for t in (0, 1, 2):
        sizes = []
        for gone in itertools.combinations(range(simhash.WIDTH), t):
            kept = values & ~sum(1 << b for b in gone)
            sizes.append((kept[:, None] == kept[None]).sum() / len(values))
        assert simhash._bucket(met, len(values), t) == pytest.approx(np.mean(sizes))


@pytest.mark.parametrize("kind", ["random", "low bits alike", "one value"])
def test_plans_are_sound(spark, kind):
    rng = random.Random(kind)
    fps = {"random": [rng.getrandbits(64) for _ in range(500)], "low bits alike": [rng.getrandbits(24) << 40 | rng.getrandbits(2) for _ in range(500)], "one value": [5]}[kind]
    dealt = simhash.plan(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long"))
    assert sorted(b for bits, _ in dealt for b in bits) == list(range(64)) and sum(t for _, t in dealt) == 3 - len(dealt) + 1


def test_measured_pairs_decide_the_plan(monkeypatch):
    """Few fingerprints: four narrow groups, equal values only. Billions: wide groups. A group whose values all share is skipped."""

    def dealt(n, *tables):
        together = np.full((64, 64), n // 4)
        np.fill_diagonal(together, n // 2)
        monkeypatch.setattr(simhash, "_together", lambda fps: (together, n))
        monkeypatch.setattr(simhash, "_histograms", lambda fps, groups: np.array(tables))
        return simhash.plan(None)

    cells = 1 << simhash.WIDTH
    even = lambda n: np.full(cells, n / cells)
    one = lambda n: np.eye(1, cells)[0] * n
    assert [(len(b), t) for b, t in dealt(1 << 17, *[even(1 << 17)] * 4)] == [(16, 0)] * 4
    many = dealt(1 << 36, *[even(1 << 36)] * 4)
    assert max(len(b) for b, _ in many) >= 32 and sum(t for _, t in many) == 4 - len(many)
    skewed = dealt(1 << 24, even(1 << 24), even(1 << 24), one(1 << 24), one(1 << 24))
    assert len(skewed) < 4 or any(t < 0 for _, t in skewed)
    assert sum(t for _, t in skewed) == 4 - len(skewed)


def test_near_templates_are_not_squared(spark, monkeypatch):
    """Thousands of fingerprints in one bucket, four bits apart or more: comparisons stay far under all pairs."""
    rng = random.Random(8)

    def word():  # extended Hamming code of 32 bits: any two words differ in four bits or more
        data = [rng.getrandbits(1) for _ in range(26)]
        bits, at = [0] * 32, 0
        for i in range(1, 32):
            if i & (i - 1):
                bits[i], at = data[at], at + 1
        for p in (1, 2, 4, 8, 16):
            bits[p] = sum(bits[i] for i in range(1, 32) if i & p and i != p) % 2
        bits[0] = sum(bits[1:]) % 2
        return sum(b << 2 * i for i, b in enumerate(bits))

    fps = sorted({word() for _ in range(5000)})
    linked = [(f, f ^ 2 ^ 8 ^ 32) for f in fps[:20]]  # three of the bits that are otherwise alike
    everything = fps + [b for _, b in linked]
    compared = []

    def counting(rows, sizes, total, tau, meet=simhash._meet):
        n = [r["n"] for r in sizes.collect()]
        compared.append(sum(k * (k - 1) // 2 if k <= simhash.SMALL_BUCKET else simhash.PIVOTS * k for k in n))
        return meet(rows, sizes, total, tau)

    monkeypatch.setattr(simhash, "_meet", counting)
    _, found = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in everything], "fp long"))
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    want = {frozenset(s) for s in linked}
    assert {frozenset(s) for s in got.values()} == want
    assert sum(compared) < len(everything) ** 2 / 2 / 10 and len(compared) <= 6


def plain_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "ONE two", "a b c d", "É x\x1cy Z a b", "a b c\na  b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = [(None, "alone without id"), (900_001, None), (900_000, ""), (900_002, "  "), (5, "a repeated id"), (900_003, "word " * 60_000)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("fp", F.lit("x")).withColumn("first", F.lit(1))
    rows = both.select("doc_id", "text").collect()
    got = simhash.near_duplicates(both).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {900_000}
    marks = {(r["doc_id"], f"{plain_fingerprint(r['text']):016x}") for r in rows}
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == marks
    fps = sorted({m for _, m in marks})
    comp = brute([int(f, 16) for f in fps])
    least = {}
    for i, m in marks:
        if i is not None:
            c = comp[fps.index(m)]
            least[c] = min(least.get(c, i), i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, m, least.get(comp[fps.index(m)])) for i, m in marks}
    both = both.withColumn("turn", F.lit(7)).withColumn("_turn", F.lit(8)).withColumn("first_id", F.lit(9)).withColumn("component_id", F.lit(10)).withColumn("key", F.lit(11))
    kept = simhash.keep_first(both)
    assert kept.columns == both.columns and {tuple(r)[-5:] for r in kept.collect()} == {(7, 8, 9, 10, 11)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {None} | set(least.values()) and ids.count(None) == 1 and len(ids) == len(set(ids))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 640)]
    edges = spark.createDataFrame([*pairs, pairs[0], (3, 3), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in plain_components(pairs, {x for p in pairs for x in p}).items() if n in nodes}
    assert components(edges.limit(0)).count() == 0


def plain_lines(rows):
    seen, out = {}, []
    key = lambda i, t: (i if i is not None else -1, int(hashlib.md5(t.encode()).hexdigest()[:15], 16))
    spots = sorted({(key(i, t), p, tuple(t.split("\n")[p : p + 3])) for i, t in rows if t is not None for p in range(t.count("\n") - 1)}, key=lambda x: x[:2])
    cut = {}
    for i, p, w in spots:
        if not "".join(w).strip(" \t\v\f\r"):
            continue
        if seen.setdefault(w, (i, p)) != (i, p):
            cut.setdefault(i, set()).update((p, p + 1, p + 2))
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines, gone = t.split("\n"), cut.get(key(i, t), set())
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone & set(range(len(lines))))))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\ny"), (104, "q\n" * 5000), (None, "a\nb\nc\nd\n"), (105, "\r\n \n\n" * 3)]
    rows += [(200, "p\nq\nr\ns\nu"), (200, "f\ng\nh\nz"), (90, "f\ng\nh"), (300, "k\nl\nm\nn")] + [(300, "k\nl\nm\nn"), (None, "f\ng\nx\ny"), (None, "v\nw\nx\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("starts", F.lit(1)).withColumn("id", F.lit(2))
    own = ["_starts", "_cut_id", "_lines", "_kept", "_stops", "lines", "c0", "cut_id"]
    for c in own:
        df = df.withColumn(c, F.lit(c))
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "starts", "id", *own, "n_lines", "n_removed"]
    assert {tuple(r) for r in got.select(*own).collect()} == {tuple(own)}
    assert sorted(map(str, [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()])) == sorted(map(str, plain_lines(rows)))
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    found = sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] in (200, 300))
    assert found == [(200, "p\nq\nr\ns\nu"), (200, "z"), (300, "k\nl\nm\nn"), (300, "k\nl\nm\nn")]  # a text's repeats cut no other text of its id


def test_line_dedup_stays_in_the_jvm(spark):
    plan = linededup.dedup_lines(read(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
