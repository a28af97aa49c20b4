"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``tau`` or fewer differing bits. The 64 bits are dealt into m
groups of correlated bits; group i gets a threshold t_i of -1 or more with
sum(t_i) = tau - m + 1. If two fingerprints differ in at most tau bits, some group
holds at most t_i of the differences (else sum(t_i + 1) = tau + 1 bits would differ),
so probing each group within its own threshold misses no link. Thresholds are unequal,
and groups wide or narrow, where it pays: a dynamic program takes those with the least
cost, by the pairs that each group brings together within each threshold, as counted
over all fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, map_rows, materialize
from .components import components

BITS = 64
#: Buckets with more fingerprints link through pivots first; smaller ones compare all their pairs.
SMALL_BUCKET = 32
#: Fingerprints of a large bucket that every other one in it is compared with.
PIVOTS = 3
#: Classes of bits that a large bucket is dealt by, tau + 1 at the usual tau.
CLASSES = 4
THRESHOLDS = (-1, 0, 1, 2, 3)
#: Bits of the narrowest groups; a table of all their values has 2 ** 16 cells, whatever the number of fingerprints.
WIDTH = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text; 0 for null or a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashed = np.frombuffer(b"".join([xxhash.xxh64_digest(p, 42) for p in pieces]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        ones += np.unpackbits(hashed[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp: long, the 64 bits as a signed number), one row per row of ``docs``, whole texts."""

    def make():
        def step(ids, texts):
            marks = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return {id_col: ids, "fp": marks}

        return step

    out = docs.select(id_col).schema.add("fp", "long")
    return map_rows(docs, [id_col, text_col], make, out)


def correlated_groups(together: np.ndarray, total: int, m: int) -> list[list[int]]:
    """Deals 64 bits into m groups of nearly equal size, each bit to those it varies with.

    ``together[i, j]`` counts the fingerprints with bits i and j both set.
    """
    share = together.diagonal() / max(total, 1)
    apart = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((together / max(total, 1) - np.outer(share, share)) / np.outer(apart, apart))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for size in (BITS // m + (i < BITS % m) for i in range(m)):
        first = max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: tie[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: np.ndarray, tau: int) -> tuple[float, list[int]]:
    """Least total cost and its thresholds, one per group, with sum tau - m + 1; costs[i, k] is that of THRESHOLDS[k] in group i."""
    m, goal = len(costs), tau - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for k, t in enumerate(THRESHOLDS):
                found = cost + costs[i, k]
                if found < step.get(total + t, (np.inf, []))[0]:
                    step[total + t] = (found, [*chosen, t])
        best = step
    return best[goal]


def _gather(fp, bits: list[int]):
    """The named bits of a fingerprint as one number, kept in their places."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _keys(fp, bits: list[int], t: int):
    """Bucket keys of one group: two fingerprints share one if and only if they differ in t or fewer of its bits."""
    if t < 0:
        return []
    out = []
    for gone in combinations(bits, t):
        left = [b for b in bits if b not in gone]
        out.append(F.struct(F.lit(str(sum(1 << b for b in gone))).alias("gone"), _gather(fp, left).alias("value")))
    return out


def _together(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of pairs of set bits over all fingerprints: one 64 x 64 matrix a partition, summed by cell."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            got = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(got), 1 << 14):
                bits = ((got[at : at + (1 << 14), None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += np.rint(bits.T @ bits).astype(np.int64)
                n += len(bits)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    found = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in found:
        flat[r["cell"]] = r["n"]
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def _histograms(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """Counts of each group's values over all fingerprints: one table of 2 ** WIDTH cells a group."""

    def run(batches):
        total = np.zeros(len(groups) << WIDTH, np.int64)
        for batch in batches:
            got = batch.column(0).to_numpy().view(np.uint64)
            for i, bits in enumerate(groups):
                value = np.zeros(len(got), np.int64)
                for k, b in enumerate(bits):
                    value |= ((got >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
                total += np.bincount(value + (i << WIDTH), minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": total[cell]})

    found = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(groups) << WIDTH)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(len(groups), -1)


def meetings(histogram: np.ndarray) -> np.ndarray:
    """For each pattern d of differing bits: ordered pairs (each with itself included) whose values differ in exactly d; by a Walsh-Hadamard transform."""
    out = histogram.astype(np.float64)
    for turn in range(2):
        step = 1
        while step < len(out):
            both = out.reshape(-1, 2, step)
            out = np.stack([both[:, 0] + both[:, 1], both[:, 0] - both[:, 1]], 1).reshape(-1)
            step *= 2
        out = out * out if not turn else out / len(out)
    return np.maximum(np.rint(out), 0)


def _bucket(met: np.ndarray, n: int, t: int) -> float:
    """Fingerprints that one meets in its bucket, on average over the fingerprints and the choices of t bits that are left out."""
    one = 1 << np.arange(WIDTH)
    pairs = one[:, None] | one[None, :]
    shares = [met[0], met[one].mean(), met[pairs[np.triu_indices(WIDTH, 1)]].mean()]
    triples = [a | b | c for a, b, c in combinations(one.tolist(), 3)]
    shares.append(met[triples].mean())
    # Values that agree in all bits but t given ones differ in any subset of those.
    return sum(_choose(t, j) * shares[j] for j in range(t + 1)) / max(n, 1)


def _work(meets: float, width: int, t: int) -> float:
    """Rows and comparisons a fingerprint costs in a group of ``width`` bits within t, if ``meets`` others are in each of its buckets: large buckets meet through pivots and are dealt once more."""
    each = meets if meets <= SMALL_BUCKET else PIVOTS + CLASSES * (1 + meets / 2.0 ** ((BITS - width) / CLASSES))
    return _choose(width, t) * (1 + each)


def _choose(n: int, k: int) -> int:
    out = 1
    for j in range(k):
        out = out * (n - j) // (j + 1)
    return out


def plan(fps: DataFrame, tau: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group, from counts over all fingerprints.

    The candidates are the four groups of correlated bits and all ways of merging some of
    them: fewer and wider groups bring fewer pairs together for more keys. A merged
    group's pairs are those of its parts, taken as independent of each other.
    """
    together, n = _together(fps)
    if not n:  # nothing to link: any sound plan will do
        return [(list(range(i, BITS, tau + 1)), 0) for i in range(tau + 1)]
    fours = correlated_groups(together, n, BITS // WIDTH)
    met = [meetings(h) for h in _histograms(fps, fours)]
    others = [[_bucket(m, n, t) - 1 for t in range(len(THRESHOLDS) - 1)] for m in met]

    def cost(group: tuple[int, ...], t: int) -> float:
        if t < 0:
            return 0.0
        # The t bits left out fall on the parts in every way; parts are alike enough to be averaged.
        if len(group) == 1:
            return _work(others[group[0]][t], WIDTH, t)
        ways, meets = 0, 0.0
        for spent in product(range(t + 1), repeat=len(group)):
            if sum(spent) == t:
                many = math.prod(_choose(WIDTH, k) for k in spent)
                ways += many
                meets += many * n * math.prod(max(0.0, others[g][k]) / n for g, k in zip(group, spent, strict=True))
        return _work(meets / ways, WIDTH * len(group), t)

    best = None
    for parts in _partitions(tuple(range(len(fours)))):
        if len(parts) > tau + 1:
            continue
        costs = np.array([[cost(g, t) for t in THRESHOLDS] for g in parts])
        total, thresholds = allocate(costs, tau)
        if best is None or total < best[0]:
            best = total, [(sorted(sum((fours[g] for g in group), [])), t) for group, t in zip(parts, thresholds, strict=True)]
    return best[1]


def _partitions(items: tuple[int, ...]):
    """All ways to split ``items`` into groups."""
    if not items:
        yield []
        return
    for rest in _partitions(items[1:]):
        yield [(items[0],), *rest]
        for i, group in enumerate(rest):
            yield [*rest[:i], (items[0], *group), *rest[i + 1 :]]


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(fps: DataFrame, dealt: list[tuple[list[int], int]]) -> DataFrame:
    """(fp, key, left): the buckets of each fingerprint, and the bits that members of one may still differ in, but for those left out."""
    keys = []
    for i, (bits, t) in enumerate(dealt):
        left = F.lit(_signed(((1 << BITS) - 1) ^ sum(1 << b for b in bits))).cast("long")
        keys += [F.struct(F.xxhash64(F.lit(i), k["gone"], k["value"]).alias("key"), left.alias("left")) for k in _keys(F.col("fp"), bits, t)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.left")


def _deal_on(rows: DataFrame, level: int, tau: int) -> DataFrame:
    """Members of buckets dealt once more: the bits they may differ in fall into tau + 1 classes, and of at most tau differences one class has none.

    So two members that link share at least one of the new buckets.
    """
    order = np.random.default_rng(level).permutation(BITS)
    masks = [_signed(sum(1 << int(b) for b in order[q :: tau + 1])) for q in range(tau + 1)]
    own = [F.col("left").bitwiseAND(F.lit(m).cast("long")) for m in masks]
    deal = [F.struct(F.xxhash64("key", F.lit(q), F.col("fp").bitwiseAND(m)).alias("key"), F.col("left").bitwiseXOR(m).alias("left")) for q, m in enumerate(own)]
    return rows.select("fp", "label", F.explode(F.array(*deal)).alias("k")).select("fp", "label", "k.key", "k.left")


def _meet(rows: DataFrame, sizes: DataFrame, total: int, tau: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): linked pairs (a, b, la, lb) of different labels, and the rows of large buckets with their ``n``.

    Members of buckets of up to SMALL_BUCKET meet each other; those of larger ones meet
    PIVOTS of their members.
    """
    mixed = materialize(rows.join(sizes, "key"), "mixed")
    few, large = mixed.where(F.col("n") <= SMALL_BUCKET), mixed.where(F.col("n") > SMALL_BUCKET)
    other = few.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"))
    met = few.select("key", F.col("fp").alias("a"), F.col("label").alias("la")).join(other, "key").where(F.col("a") < F.col("b"))
    salted = [F.min(F.struct(F.xxhash64("fp", F.lit(i)), F.col("fp"), F.col("label"))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = large.groupBy("key", "n").agg(*salted)
    pivots = pivots.select("key", "n", F.array(*[F.struct(f"p{i}.fp", f"p{i}.label") for i in range(PIVOTS)]).alias("pivots"))
    through = hot_join(large.drop("n"), pivots, ["key"], total, F.xxhash64("fp")).select(F.col("fp").alias("a"), F.col("label").alias("la"), F.explode(F.array_distinct("pivots")).alias("p"))
    through = through.select("a", F.col("p.fp").alias("b"), "la", F.col("p.label").alias("lb"))
    pairs = met.select("a", "b", "la", "lb").unionByName(through).where(F.col("la") != F.col("lb")).where(_differ("a", "b") <= tau)
    return materialize(pairs.distinct(), "pairs"), large


def links(fps: DataFrame, tau: int = 3) -> tuple[DataFrame, DataFrame]:
    """(edges, components) over distinct fingerprints ``fps`` (fp: long); edges (a, b) span every component.

    Small buckets compare all pairs. In large ones every member meets PIVOTS members. A
    large bucket whose members then lie in several components is dealt once more, by
    classes of the bits its members may still differ in, and so on until buckets are
    small or of one component: a link is in at least one bucket of each level, pairs
    inside a component need no comparison, and no bucket of more than SMALL_BUCKET is
    squared. A level has at most tau + 1 rows for each row that is dealt on, and as three
    quarters of the differing bits are left each time, there are few levels.
    """
    rows = materialize(_buckets(fps, plan(fps, tau)).withColumn("label", F.col("fp")), "buckets")
    edges, found, level = None, None, 0
    while True:
        mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        sizes = materialize(mixed.where("n > 1 and low <> high").select("key", "n"), "sizes")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        pairs, large = _meet(rows, sizes, total, tau)
        merged = components(pairs.select(F.col("la").alias("a"), F.col("lb").alias("b")), "fp-components")
        now = pairs.select("a", "b")
        edges = now if edges is None else edges.unionByName(now)
        found = merged if found is None else _follow(found, merged)
        if not total or not large.limit(1).count():
            return edges, found
        # Large buckets of several components go on.
        moved = merged.select(F.col("node").alias("label"), "component")
        rows = large.join(moved, "label", "left").select("fp", "key", "left", F.coalesce("component", "label").alias("label"))
        rows = materialize(rows, "labelled")
        several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        level += 1
        rows = rows.join(several, "key", "left_semi")
        rows = materialize(_deal_on(rows, level, tau), "dealt")


def _follow(found: DataFrame, merged: DataFrame) -> DataFrame:
    """``found`` (node, component) after components were ``merged``; nodes that had no link before come in."""
    joined = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
    moved = joined.select("node", F.coalesce("joined", "component").alias("component"))
    return materialize(moved.unionByName(merged.join(found.select("node"), "node", "left_anti")), "fp-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id reachable by links).

    Null and wordless texts have fingerprint zero and link like any other. Equal texts
    are one fingerprint, so groups of copies never become pairs. Null ids are kept and
    never are a component_id unless a component has no other. Other columns are ignored.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    _, found = links(distinct.select("fp"), tau)
    group = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    group = group.join(least, "component").select("fp", "component_id")
    return marks.join(group, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the least id.

    Of rows that repeat that id one stays (least hash of the text). Rows without id
    can't be told apart and stay. All columns of ``docs`` are kept.
    """
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, tau)
    first = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("first_id")).distinct()
    # Columns have names of their own until the end, so none of the caller's is in the way.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    turn = Window.partitionBy(key).orderBy(F.xxhash64(text))
    kept = plain.join(first, key == F.col("first_id"), "left_semi").withColumn("turn", F.row_number().over(turn)).where("turn = 1").drop("turn")
    return kept.unionByName(plain.where(key.isNull())).toDF(*docs.columns)
