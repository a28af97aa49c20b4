"""Vector code compression: a codebook for each part of the vector, a code of entry indexes for each row.

The nearest entry is found by lower bounds from coarse to fine. Where a vector part is cut
into blocks, its squared distance to an entry is at least the sum over blocks of block
length * squared difference of the means, plus squared difference of the residual norms;
entries whose bound exceeds a distance already seen are out. Bounds are doubles, lowered
by more than their rounding, so no nearest entry is ever lost; survivors receive exact
integer distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .vectors import exact_means, finite, floored, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose bounds to all entries are in memory at a time.
ROWS = 2048
#: Bounds give way by so much of the squared norms, some thousand times their rounding errors.
SLACK = 1e-12


def _blocks(width: int) -> list[np.ndarray]:
    """Where blocks begin, from one block to blocks of about two components."""
    out, n = [], 1
    while n <= max(1, width // 2):
        out.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return out


class Levels:
    """Block means and residual norms of rows, one matrix a level: distances between its rows are lower bounds of distances between the rows themselves."""

    def __init__(self, x: np.ndarray):
        self.exact = x
        plain, width = x.astype(np.float64), x.shape[1]
        self.norms = (plain * plain).sum(1)
        self.levels = []
        for starts in _blocks(width):
            lengths = np.diff(np.append(starts, width))
            mean = np.add.reduceat(plain, starts, axis=1) / lengths
            rest = plain - np.repeat(mean, lengths, axis=1)
            residual = np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))
            self.levels.append(np.hstack([mean * np.sqrt(lengths), residual]))

    def distances(self, rows: np.ndarray, other: Levels, entries: np.ndarray) -> np.ndarray:
        apart = self.exact[rows] - other.exact[entries]
        return (apart * apart).sum(1)


def nearest(x: np.ndarray, book: Levels) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row's nearest entry, ties to the lower index, and how many entries got to the last, exact step."""
    rows = Levels(x)
    norms = rows.norms[:, None] + book.norms
    alive, most = np.True_, np.full(len(x), np.iinfo(np.int64).max)
    for own, other in zip(rows.levels, book.levels, strict=True):
        bound = np.where(alive, norms * (1 - SLACK) - 2 * (own @ other.T), np.inf)
        # The likeliest entry's exact distance is one that the others have to beat.
        most = np.minimum(most, rows.distances(np.arange(len(x)), book, bound.argmin(1)))
        alive = bound <= most[:, None]
    row, entry = np.nonzero(alive)
    distance = rows.distances(row, book, entry)
    best = _first_least(distance, row)
    return entry[best], distance[best], len(row)


def _first_least(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where each row's least value is first; every row is there, in ascending order."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.repeat(np.minimum.reduceat(values, starts), np.diff(np.append(starts, len(row))))
    at = np.flatnonzero(values == least)
    return at[np.flatnonzero(np.diff(row[at], prepend=-1))]


def _codes(x: np.ndarray, books: list[Levels]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column a part) and errors of rows."""
    width, codes, error = x.shape[1] // len(books), np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for low in range(0, len(x), ROWS):
        for p, book in enumerate(books):
            codes[low : low + ROWS, p], distance, _ = nearest(x[low : low + ROWS, p * width : (p + 1) * width], book)
            error[low : low + ROWS] += distance
    return codes, error


def train(kept: DataFrame, parts: int, entries: int, rounds: int, width: int) -> list[np.ndarray] | None:
    """The codebooks (entries by components of a part) for ``kept`` (id, v: whole numbers); None without rows."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    start, spark = np.array([r["v"] for r in first], np.int64), kept.sparkSession
    own = width // parts
    books = [start[:, p * own : (p + 1) * own].copy() for p in range(parts)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def add_up(batches, sent=sent):
            levels = [Levels(b) for b in sent.value]
            held = len(sent.value[0])
            counts, sums = np.zeros((parts, held), np.int64), np.zeros((parts, held, own), np.int64)
            for batch in batches:
                for low in range(0, len(batch), ROWS):
                    x = matrix(batch["v"].iloc[low : low + ROWS])
                    codes, _ = _codes(x, levels)
                    for p in range(parts):
                        counts[p] += np.bincount(codes[:, p], minlength=held)
                        # A slice's sums are below 2 ** 53, so doubles hold them exactly.
                        for i in range(own):
                            sums[p, :, i] += np.bincount(codes[:, p], x[:, p * own + i], held).astype(np.int64)
            p, e = np.nonzero(counts)
            if len(p):
                yield pd.DataFrame({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "sums": list(sums[p, e])})

        moved = exact_means(kept.select("v").mapInPandas(add_up, "part int, entry int, n long, sums array<long>"), ["part", "entry"])
        books = [b.copy() for b in books]
        for (p, e), mean in moved.items():
            books[p][e] = mean
        sent.unpersist()
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): every kept vector's code and its squared error.

    Vectors that are null or hold null or non-finite components are dropped, as are those of
    another length than most (of equally frequent lengths the shorter) and lengths that
    ``parts`` doesn't divide. Each component x becomes floor(scale * x). Codebooks start with
    the kept vectors of the smallest ids; rows without id come last, of equal ids the
    smaller vector comes first, and rows that repeat an id are one vector each. With fewer
    vectors than ``entries`` the codebooks are as short; without any the result has no
    rows. Equal vectors have equal codes, ties go to the lower index, unused entries stay.
    ``label_error`` adds the errors of equal labels, null labels together; without
    ``label_col`` it adds all. Components beyond ``vectors.LARGEST`` after scaling are an
    error. Other columns are ignored.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    usable = vectors.where(finite(vector_col) & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
    whole = materialize(usable.select(F.col(id_col).alias("id"), label.isNull().alias("bare"), F.coalesce(label, F.lit("")).alias("label"), floored(vector_col, scale).alias("v")), "whole")
    most = whole.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if most is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width, total = most
    kept = whole.where(F.size("v") == width)
    books = train(kept, parts, entries, rounds, width)
    sent, digits = spark.sparkContext.broadcast(books), max(2, len(f"{len(books[0]) - 1:x}"))

    def encode(batches):
        levels = [Levels(b) for b in sent.value]
        names = np.array([f"{e:0{digits}x}" for e in range(len(sent.value[0]))], object)
        for batch in batches:
            if len(batch):
                codes, error = _codes(matrix(batch["v"]), levels)
                yield pd.DataFrame({"id": batch["id"], "bare": batch["bare"], "label": batch["label"], "code": names[codes].sum(1), "error": error})

    # Ids travel as text, since pandas would turn whole numbers beside nulls into doubles.
    coded = materialize(kept.withColumn("id", F.col("id").cast("string")).mapInPandas(encode, "id string, bare boolean, label string, code string, error long"), "coded")
    sums = coded.groupBy("bare", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    # A label may hold most rows: its sum is dealt over tasks.
    met = hot_join(coded, sums, ["bare", "label"], total, F.xxhash64("id", "code"))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()
    return met.select(F.col("id").cast(kind).alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
