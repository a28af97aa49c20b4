"""Document fingerprints against plain code; segments, ends of runs, odd rows."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import digests as D
from lumenspan.llm.common import read
from lumenspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def step_of(window):
    total = sum(round(c * np.log2(c) * (1 << 30)) for c in Counter(window).values())
    return min(1000, max(0, 1000 - total * 1000 // (64 * 6 << 30)))


def plain_steps(text):
    data = (text or "").encode()
    data = data + b"\0" * (64 - len(data)) if 0 < len(data) < 64 else data
    return data, [step_of(data[i : i + 64]) for i in range(len(data) - 63)]


def plain_hash(window):
    h, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for k in range(0, 64, 8):
        h ^= int.from_bytes(window[k : k + 8], "little")
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        h ^= h >> 31
    return h


def plain_digest(text, rank):
    """[(bits set, features)] of the filters, by the definition."""
    data, steps = plain_steps(text)
    points = Counter()
    if not steps:
        return []
    for low in range(-63, len(steps)):
        run = [(rank[steps[i]], i) for i in range(max(0, low), min(len(steps), low + 64))]
        points[min(run)[1]] += 1
    seen, filters = set(), []
    for i in sorted(i for i, n in points.items() if n >= 16):
        h = plain_hash(data[i : i + 64])
        if h in seen:
            continue
        if len(seen) % 160 == 0:
            filters.append([set(), 0])
        seen.add(h)
        filters[-1][0].update(h >> 11 * k & 2047 for k in range(5))
        filters[-1][1] += 1
    return filters


def shown(filters):
    return ",".join(f"{n}:{base64.b64encode(sum(1 << b for b in bits).to_bytes(256, 'little')).decode()}" for bits, n in filters)


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    order = lambda x: (len(x), sum(n for _, n in x), b"".join(sum(1 << k for k in bits).to_bytes(256, "little") for bits, _ in x))
    if order(b) < order(a):
        a, b = b, a
    total = 0.0
    for bits, n in a:
        best = 0.0
        for other, _ in b:
            chance = len(bits) * len(other) / 2048
            best = max(best, ((len(bits & other) - chance) / max(1e-9, min(len(bits), len(other)) - chance) - 0.1) / 0.9)
        total += n * best
    return min(1.0, max(0.0, total / sum(n for _, n in a)))


def plain_rows(rows):
    """Of (id, text) rows: what the query returns, by the definition."""
    counts = Counter(s for _, t in rows for s in plain_steps(t)[1])
    order = sorted(range(1001), key=lambda s: (s < 100, counts[s], s))
    rank = {s: k for k, s in enumerate(order)}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    made = {t: plain_digest(t, rank) for t in {t or "" for _, t in rows}}
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[k - 1][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        e, own = plain_digest(edited, rank), made[text]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(e), plain_likeness(own, e), plain_likeness(own, made[after])))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], abs=1e-12) for r in want]


def test_steps_are_brute_force():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 300), rng.integers(97, 101, 300), np.full(200, 65), np.arange(64)):
        data = data.astype(np.uint8)
        assert D.entropy_steps(data).tolist() == [step_of(data[i : i + 64].tobytes()) for i in range(len(data) - 63)]


def test_query_is_brute_force(spark):
    """Short documents of the smallest table, in runs of 9 documents, and with every case of odd rows."""
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").orderBy(F.length("text")).limit(30).collect()]
    odd = [(-5, None), (-4, ""), (-3, "x"), (-2, "ß日本" * 50), (10_000, rows[3][1]), (10_001, "a" * 500), (None, "without an id " * 9), (10_002, "x"), (10_003, "y" * 63), (10_004, "z" * 64)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "run", "lead", "h", "i", "has", "n_chars", "fingerprint")]).repartition(5)
    got = D.compare_edits(df, run_rows=9)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same(got.collect(), plain_rows(rows + odd))
    same(D.compare_edits(df).collect(), plain_rows(rows + odd))  # one run
    assert D.compare_edits(df.limit(0)).collect() == []
    one = D.compare_edits(df.where("doc_id = -2")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    prints = {r["doc_id"]: r["fingerprint"] for r in D.fingerprints(df).collect()}
    assert prints == {r["doc_id"]: r["fingerprint"] for r in got.collect()}


def test_repeated_rows(spark):
    rows = [(7, "seven " * 40)] * 3 + [(8, "eight " * 40), (8, "ate " * 50), (None, None), (None, None), (None, "no id " * 30)]
    got = D.compare_edits(spark.createDataFrame(rows, "doc_id long, text string"), run_rows=2).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 7) >= 2
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 7}) == 1


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 20, n)) for n in (5, 64, 65, 3000, 127, 900, 0, 126)] + [None, "q" * 700]
    rank = D.ranks(D.histogram(texts))
    whole, counts = [str(d) for d in D.digests(texts, rank)], D.histogram(texts)
    alone = [str(D.digests([t], rank)[0]) for t in texts]
    for size in (64, 100, 1000):
        monkeypatch.setattr(D, "SEGMENT", size)
        assert [str(d) for d in D.digests(texts, rank)] == whole == alone
        assert (D.histogram(texts) == counts).all() and counts.sum() == sum(max(len(t) - 63, 1) for t in texts if t)


def test_long_texts_and_likeness(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words, 60_000))
    other = " ".join(rng.choice(words, 60_000))
    rank = D.ranks(D.histogram([long, other]))
    a, b, c = D.digests([long, long[: 2 * len(long) // 3] + other[: len(long) // 3], other], rank)
    assert len(a.counts) > 20 and a.counts[:-1].tolist() == [160] * (len(a.counts) - 1)
    assert D.likeness(a, a) == 1.0 and 0.55 < D.likeness(a, b) < 0.85 and D.likeness(a, c) < 0.1
    assert D.likeness(a, b) == D.likeness(b, a)


def test_edits_are_near_and_others_far(spark):
    got = QUERIES["op11_document_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = Counter(r["fingerprint"] for r in got)
    assert len(by_text) <= len(got)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)
    assert np.median([r["near_edited"] for r in got]) > 0.5 and np.median([r["near_next"] for r in got]) < 0.1
    assert not any(math.isnan(r["near_edited"]) for r in got)
