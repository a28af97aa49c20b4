"""Document fingerprints: digests of improbable features, compared by the bits they share.

A feature is a window of 64 bytes. Its entropy, in steps of a thousandth, has a rank: the
rarer that step is among all windows of all documents, the smaller. In every run of 64
neighbouring windows the one of least rank (the leftmost of equals) earns a point; those
with enough points are selected, about one in a few dozen bytes. Each distinct selected
feature sets five bits of a Bloom filter of 2048 bits; after 160 features a new filter
follows. Two digests are alike as far as the filters of the one with fewer share bits
with their best counterparts beyond what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, sample_share

#: Bytes of a feature, and features that compete for a point.
WINDOW = RUN = 64
#: Points that select a feature.
POINTS = 16
#: Steps of entropy; windows below LOW (runs of few characters) say little and rank last.
STEPS, LOW = 1000, 100
#: Bits and features of a Bloom filter, bits that a feature sets.
BITS, FEATURES, HASHES = 2048, 160, 5
#: Share of the possible overlap beyond chance below which filters count as unlike.
CUTOFF = 0.1
#: Windows that are worked on at a time, whatever the texts' lengths.
SEGMENT = 1 << 19
#: Rows of an ordered run of documents, and the most runs; beyond that runs grow.
RUN_ROWS, MOST_RUNS = 2048, 1 << 17

# Entropy of a window is 6 - (sum of c * log2 c over its bytes' counts c) / 64, kept in whole numbers.
_UNIT = 1 << 30
_PLOGP = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_PLOGP)


def padded(texts: list[str | None]) -> list[bytes]:
    """UTF-8 of texts; shorter ones than a window are filled up with zero bytes, empty ones stay empty."""
    return [t.encode().ljust(WINDOW, b"\0") if t else b"" for t in texts]


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """The step of each window's entropy: windows slide by one byte, and only the counts of the byte that leaves and the one that enters change."""
    n = len(data) - WINDOW + 1
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        ahead[:-lag] += same  # how often a byte comes again in the rest of a window that starts with it
        behind[lag:] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    sums = np.empty(n, np.int64)
    sums[0] = _PLOGP[first].sum()
    sums[1:] = sums[0] + np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]])
    return np.clip(STEPS - sums * STEPS // (WINDOW * 6 * _UNIT), 0, STEPS).astype(np.int32)


def _segments(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, start, steps, inside) of stretches of joined texts that own the windows from ``low`` on.

    ``steps`` begins at ``start``: RUN - 1 windows on either side come along, so every window that
    competes with an own one is there. ``inside`` tells whether a window lies within one text.
    """
    windows = len(data) - WINDOW + 1
    for low in range(0, windows, SEGMENT):
        start, stop = max(0, low - RUN + 1), min(windows, low + SEGMENT + RUN - 1)
        inside = np.ones(stop - start, bool)
        for end in ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, stop + WINDOW, "left")]:
            inside[max(0, end - WINDOW + 1 - start) : max(0, end - start)] = False
        yield low, start, entropy_steps(data[start : stop + WINDOW - 1]), inside


def histogram(texts: list[str | None]) -> np.ndarray:
    """How many windows of the texts have each step of entropy."""
    parts = padded(texts)
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    out = np.zeros(STEPS + 1, np.int64)
    if len(data):
        for low, start, steps, inside in _segments(data, ends):
            own = slice(low - start, low - start + SEGMENT)
            out += np.bincount(steps[own][inside[own]], minlength=STEPS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each step: the rarest first, of equals the smaller step; steps below LOW come after all others."""
    order = np.lexsort((np.arange(STEPS + 1), counts, np.arange(STEPS + 1) < LOW))
    out = np.empty(STEPS + 1, np.int32)
    out[order] = np.arange(STEPS + 1)
    return out


def _selected(data: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the selected windows, ascending."""
    out = [np.zeros(0, np.int64)]
    bits = int(SEGMENT + 4 * RUN).bit_length()
    for low, start, steps, inside in _segments(data, ends):
        none = np.int64((STEPS + 2) << bits)
        # Rank, then place: the least of a run is its leftmost best. Runs may hang over the ends.
        key = np.full(len(steps) + 2 * (RUN - 1), none)
        place = np.arange(len(steps), dtype=np.int64)
        key[RUN - 1 : RUN - 1 + len(steps)] = np.where(inside, (rank[steps].astype(np.int64) << bits) | place, none)
        width = 1
        while width < RUN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        won = key[key < none] & ((1 << bits) - 1)
        found = np.flatnonzero(np.bincount(won, minlength=len(steps)) >= POINTS) + start
        out.append(found[(found >= low) & (found < low + SEGMENT)])
    return np.concatenate(out)


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each window."""
    words = data[starts[:, None] + np.arange(WINDOW)].view("<u8")
    h = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


class Digest:
    """Bloom filters of a text (a row of bytes each) and the features in each."""

    __slots__ = ("filters", "counts", "_set")

    def __init__(self, filters: np.ndarray, counts: np.ndarray):
        self.filters, self.counts, self._set = filters, counts, None

    def __str__(self) -> str:
        return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts.tolist(), self.filters, strict=True))

    @property
    def set_bits(self) -> np.ndarray:
        if self._set is None:
            self._set = np.bitwise_count(self.filters).sum(1, dtype=np.int64)
        return self._set


def digests(texts: list[str | None], rank: np.ndarray) -> list[Digest]:
    """The digest of each text; empty texts have no filter, all others at least one feature."""
    parts = padded(texts)
    ends = np.cumsum([0] + [len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = _selected(data, ends[1:], rank) if len(data) else np.zeros(0, np.int64)
    text, h = np.searchsorted(ends, starts, "right") - 1, _hashes(data, starts) if len(starts) else np.zeros(0, np.uint64)
    # A feature counts once a text, where it is first.
    order = np.lexsort((starts, h, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (h[order][1:] != h[order][:-1])
    first = np.sort(order[new])
    text, h = text[first], h[first]
    many = np.bincount(text, minlength=len(texts))
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    filters = -(-many // FEATURES)
    base = np.cumsum(filters) - filters
    own = base[text] + number // FEATURES
    cells = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        cells[own, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed, counts = np.packbits(cells, axis=1, bitorder="little"), np.bincount(own, minlength=len(cells))
    return [Digest(packed[b : b + n], counts[b : b + n]) for b, n in zip(base.tolist(), filters.tolist(), strict=True)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: of the digest with fewer features, each filter's best overlap with one of the other's, weighted by its features.

    Overlap is counted from what filters of so many bits share by chance (0) to all bits of
    the sparser one (1); the first CUTOFF of that counts as nothing. Two empty digests are
    alike, an empty one and another are not. Symmetric.
    """
    if not len(a.counts) or not len(b.counts):
        return float(len(a.counts) == len(b.counts))
    if (len(b.counts), int(b.counts.sum()), b.filters.tobytes()) < (len(a.counts), int(a.counts.sum()), a.filters.tobytes()):
        a, b = b, a
    best, mine, theirs = np.zeros(len(a.counts)), a.filters.view("<u8"), b.filters.view("<u8")
    for i in range(0, len(mine), 64):
        for j in range(0, len(theirs), 64):
            left, right = a.set_bits[i : i + 64, None], b.set_bits[None, j : j + 64]
            shared = np.bitwise_count(mine[i : i + 64, None] & theirs[None, j : j + 64]).sum(2, dtype=np.int64)
            chance = left * right / BITS
            room = np.maximum(np.minimum(left, right) - chance, 1e-9)
            score = ((shared - chance) / room - CUTOFF) / (1 - CUTOFF)
            best[i : i + 64] = np.maximum(best[i : i + 64], score.max(1))
    return float(np.clip(np.average(best, weights=a.counts), 0.0, 1.0))


# -- on Spark -------------------------------------------------------------------


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of entropy steps by their windows in all texts of ``docs``; a task sends its STEPS + 1 sums."""

    def run(batches):
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                total += histogram(texts)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["step", "n"])

    found = docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n"))
    counts = np.zeros(STEPS + 1, np.int64)
    for row in found.collect():  # a row a step
        counts[row["step"]] = row["n"]
    return ranks(counts)


#: Bytes of texts that are digested at once (a longer text is alone).
SLICE_BYTES = 1 << 20


def _slices(column) -> Iterator[list[str | None]]:
    """A column of texts in lists of bounded size."""
    sizes, low, held = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0, 0
    for at, n in enumerate(sizes.tolist()):
        if at > low and held + n > SLICE_BYTES:
            yield column.slice(low, at - low).to_pylist()
            low, held = at, 0
        held += n
    if low < len(sizes):
        yield column.slice(low).to_pylist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """(id_col, n_chars, fingerprint) of every text; null texts count as empty ones, whose fingerprint is empty. Equal texts have equal fingerprints."""
    rank = corpus_ranks(docs, text_col) if rank is None else rank
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def make():
        def step(ids, texts):
            return {id_col: ids, "n_chars": [len(t or "") for t in texts], "fingerprint": [str(d) for d in digests(texts, rank)]}

        return step

    return map_rows(docs, [id_col, text_col], make, schema)


def in_order(docs: DataFrame, id_col: str, text_col: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """(run, lead, id, text): all documents ascending by id in runs, each run in one partition after a copy of the document before it (lead).

    Ids are compared as longs, null ones come first, equal ones go by a hash of the text, then
    by the text. Bounds of runs come from a sample of ids; which document ends a run, from
    all ids. Texts move once.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = plain.select(F.col("id").isNotNull().cast("int").alias("has"), F.coalesce("id", F.lit(0)).alias("i"), F.xxhash64("text").alias("h"), "id", "text")
    keys = materialize(keyed.select("has", "i", "h"), "keys")
    rows = keys.count()
    runs = max(1, min(MOST_RUNS, -(-rows // run_rows)))
    found = np.array(sorted(tuple(r) for r in keys.sample(sample_share(40 * runs, rows), 23).collect()), np.int64).reshape(-1, 3)
    bounds = np.unique(found[np.arange(1, runs) * len(found) // runs], axis=0) if len(found) else found
    sent = spark.sparkContext.broadcast([tuple(b) for b in bounds.tolist()])

    @F.pandas_udf("int")
    def run_of(has, i, h):
        import pandas as pd

        edges = np.array(sent.value, np.int64).reshape(-1, 3)
        own = np.column_stack([has, i, h]).astype(np.int64)
        # One sort of bounds and rows tells how many bounds a row is not below.
        both = np.concatenate([edges, own])
        order = np.lexsort((np.arange(len(both)) >= len(edges), both[:, 2], both[:, 1], both[:, 0]))
        before = np.cumsum(order < len(edges))
        out = np.empty(len(both), np.int64)
        out[order] = before
        return pd.Series(out[len(edges) :].astype(np.int32))

    dealt = keyed.withColumn("run", run_of("has", "i", "h"))
    ends = keys.withColumn("run", run_of("has", "i", "h")).groupBy("run").agg(F.max(F.struct("has", "i", "h")).alias("end")).orderBy("run").collect()  # a row a run
    # The document before a run ends the run before it; before the first comes the last.
    leads = [(int(r["run"]), *ends[k - 1]["end"]) for k, r in enumerate(ends)]
    wanted = spark.createDataFrame(leads, "run int, has int, i long, h long")
    copies = keyed.join(F.broadcast(wanted), ["has", "i", "h"]).groupBy("run").agg(F.max(F.struct("has", "i", "h", "id", "text")).alias("c")).select("run", "c.*")
    columns = ["run", "lead", "has", "i", "h", "id", "text"]
    joined = dealt.withColumn("lead", F.lit(0)).select(columns).unionByName(copies.withColumn("lead", F.lit(-1)).select(columns))
    return joined.repartition("run").sortWithinPartitions("run", "lead", "has", "i", "h", "text").select("run", "lead", "id", "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document has the next smaller id (after the smallest comes the largest; ids are
    whole numbers, rows without id come after all others). The edited text is the document's,
    its last floor(n_chars / 3) code points replaced by as many first ones of the next
    document, or all it has. Null texts count as empty. Rows that repeat an id follow each
    other by a hash of their texts; rows equal in id and text lie in one run. A single
    document is its own next one, an empty table has no rows. Other columns are ignored.
    """
    rank = corpus_ranks(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        before: tuple[str, Digest] | None = None  # the document that is next for the one at hand
        rank = shared.value
        for batch in batches:
            low = 0
            for texts in _slices(batch.column(3)):
                leads, ids = (batch.column(c).slice(low, len(texts)).to_pylist() for c in (1, 2))
                low += len(texts)
                texts = [t or "" for t in texts]
                own = digests(texts, rank)
                chain = [before, *zip(texts, own, strict=True)]
                at = [k for k, lead in enumerate(leads) if not lead]
                edited = []
                for k in at:
                    third = len(texts[k]) // 3
                    edited.append(texts[k][: len(texts[k]) - third] + chain[k][0][:third])
                made = digests(edited, rank)
                rows = [(ids[k], len(texts[k]), hashlib.sha256(e.encode()).hexdigest(), str(own[k]), str(d), likeness(own[k], d), likeness(own[k], chain[k][1])) for k, e, d in zip(at, edited, made, strict=True)]
                before = chain[-1]
                yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(names)}, schema=schema)

    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    out = in_order(docs, id_col, text_col, run_rows).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("id").cast(kind).alias(id_col), *names[1:])
