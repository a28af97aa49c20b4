"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length.

Lengths are whole numbers up to ``size``, so the whole corpus's packing is decided by
the histogram of lengths alone: a few thousand numbers, whatever the number of
documents. The plan walks the lengths downwards and asks a segment tree over the
remaining capacities for the tightest open bin, exactly as the document-by-document
algorithm does; equal documents going to equally full bins move together as a run.
Executors then rank the pieces of each length and look their places up in the runs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize
from .wordpiece import byte_symbols

SIZE = 2048
#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
CACHE_WORDS = 300_000
#: Texts that are encoded together: rows, and characters.
TEXTS, CHARS = 4096, 6 << 20
#: Rows of one length that are ranked in one task.
RANKED_ROWS = 100_000
#: Texts with other characters, or an added token's start, go to the tokenizer whole: white space and case folding are plain only here.
PLAIN = re.compile("[\t\n\v\f\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
#: The tokenizer file's splitting pattern, a fixed value.
WORD = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"


def _spread(lengths: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the picked stretches' items, one stretch after the other, and where each ends (0 first)."""
    n = lengths[picked]
    ends = np.append(0, np.cumsum(n))
    return np.repeat(starts[picked] - ends[:-1], n) + np.arange(ends[-1]), ends


@cache  # a worker goes on with the words of its earlier tasks
def document_ids(path: str, end_id: int = 0) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit numbers, each with ``end_id`` after it.

    The ids are those of ``tokenizers`` without special tokens. Its model works word by
    word after normalising and splitting, so each distinct word is encoded once; texts are
    put together from their words' ids column by column.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; more threads only hold memory
    whole = Tokenizer.from_file(path)
    pieces_of = whole.model.tokenize  # for words that are normalised, split and written in byte symbols
    symbols = {b: ord(c) for c, b in byte_symbols().items()}
    end = np.array([end_id], "<u4").tobytes()
    known: dict[str, bytes] = {}

    def learn(words: list[str]) -> None:
        new = [w for w in words if w not in known]
        if new:
            ids = [[t.id for t in pieces_of(w if w.isascii() else w.encode().decode("latin-1").translate(symbols))] if w else [] for w in new]
            flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = (4 * np.cumsum([len(x) for x in ids])).tolist()
            known.update(zip(new, [flat[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def plain(texts: list[str]) -> list[bytes]:
        if len(known) > CACHE_WORDS:
            known.clear()
        chunks = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        told = chunks.flatten().dictionary_encode()
        mixed = pc.invert(pc.utf8_is_alpha(told.dictionary))
        apart = pc.replace_with_mask(told.dictionary, mixed, pc.replace_substring_regex(told.dictionary.filter(mixed), WORD, r"\1 "))
        words = pc.ascii_split_whitespace(apart)
        each = words.flatten().dictionary_encode()
        listed = each.dictionary.to_pylist()
        learn(listed)
        found = [known[w] for w in listed]
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, ends = _spread(n, np.cumsum(n) - n, each.indices.to_numpy())  # words to chunks
        ids, ends = ids[at], ends[words.offsets.to_numpy()]
        at, stops = _spread(np.diff(ends), ends[:-1], told.indices.to_numpy())  # chunks to texts
        data, stops = ids[at].tobytes(), 4 * stops[chunks.offsets.to_numpy()]
        return [data[a:b] + end for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        group, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = end
            elif PLAIN.fullmatch(text) and "<|" not in text:
                group.append(i)
                chars += len(text)
                if chars > CHARS:
                    for k, got in zip(group, plain([texts[k] for k in group]), strict=True):
                        out[k] = got
                    group, chars = [], 0
            else:
                out[i] = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
        if group:
            for k, got in zip(group, plain([texts[k] for k in group]), strict=True):
                out[k] = got
        return out

    return run


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids cut into pieces of ``size``, the last one shorter. Null texts count as empty."""

    def make():
        encode = document_ids(tokenizer_path)

        def step(ids, texts):
            out = {c: [] for c in (id_col, "piece", "start", "length", "ids_crc32")}
            for key, data in zip(ids, encode(texts), strict=True):
                for n, at in enumerate(range(0, len(data), 4 * size)):
                    cut = data[at : at + 4 * size]
                    for c, v in zip(out, (key, n, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        out[c].append(v)
            return out

        return step

    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    return map_rows(docs, [id_col, text_col], make, schema, TEXTS)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them have open bins; the least one at or above a length in logarithmic time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = on
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = self.leaves + length
        if self.any[at]:
            return length
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


@dataclass(frozen=True)
class Run:
    """Pieces of one length with rank in [first, first + count): ``each`` of them go into one bin, bins from ``bin`` on, at ``offset``."""

    length: int
    first: int
    count: int
    each: int
    bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], size: int = SIZE) -> list[Run]:
    """The runs that place ``histogram[length]`` pieces of each length.

    Bins of equal remaining capacity are held as intervals of bin numbers. A bin that is
    the tightest for a length stays so while it fits, hence takes ``capacity // length``
    of them at once.
    """
    tree, open_bins, bins, runs = CapacityTree(size), {}, 0, []

    def put(capacity: int, low: int, high: int) -> None:
        if low < high and capacity:
            if capacity not in open_bins:
                open_bins[capacity] = []
                tree.set(capacity, True)
            open_bins[capacity].append((low, high))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, first = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, need = size, -(-left // (size // length))
                low, high = bins, bins + need
                bins += need
            else:
                low, high = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    del open_bins[capacity]
                    tree.set(capacity, False)
            each = capacity // length
            count = min(left, (high - low) * each)
            full, rest = divmod(count, each)
            runs.append(Run(length, first, count, each, low, size - capacity))
            put(capacity - each * length, low, low + full)
            if rest:
                put(capacity - rest * length, low + full, low + full + 1)
            put(capacity, low + full + bool(rest), high)
            left, first = left - count, first + count
    return runs


def place(found: DataFrame, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """``found`` (pieces, kept in the shared folder) with sequence_id and offset.

    Pieces of one length are ranked in as many tasks as their number needs, so a length
    that holds a third of all pieces is no bottleneck.
    """
    spark = found.sparkSession
    salts = max(64, -(-found.count() // RANKED_ROWS) * 4)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_decreasing(histogram, size)
    table = np.array([(r.length, r.first, r.each, r.bin, r.offset) for r in runs] or np.zeros((0, 5)), np.int64)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # Runs by (length, first), as one ascending key; their number depends on size alone.
    order = np.lexsort((table[:, 1], table[:, 0]))
    lookup = spark.sparkContext.broadcast(np.ascontiguousarray(table[order]))
    columns = [id_col, "piece", "start", "length", "ids_crc32"]

    def assign(batches):
        runs = lookup.value
        bounds = {int(n): (a, b) for n in np.unique(runs[:, 0]) for a, b in [np.searchsorted(runs[:, 0], [n, n + 1])]}
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                low, high = bounds[int(n)]
                mine = length == n
                at[mine] = low + np.searchsorted(runs[low:high, 1], rank[mine], side="right") - 1
            _, first, each, low, offset = runs[at].T
            of = rank - first
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(low + of // each), pa.array(offset + of % each * length)], names=[*columns, "sequence_id", "offset"])

    schema = T.StructType([found.schema[c] for c in columns] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*columns, "_rank").mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id. Rows that repeat an id are packed each;
    null ids are kept. Empty tables give no rows. Other columns are ignored.
    """
    found = materialize(pieces(docs, tokenizer_path, size, id_col, text_col), "pieces")
    return place(found, size, id_col)
