"""The stored inverted index (SNK12, SNK13, TOP1, FTS3, §1.3): segments of blocks.

Chunks lie in buckets of BUCKET neighbours of like length. A block holds a term's
postings of one bucket, one row: how many they are, the largest score that any of them can
add, and one array of numbers that tell spot, column and position of every occurrence. Blocks are sorted by term in files of bounded size, whose first terms
are known, so a term's or a prefix's blocks are a range of files, and what only needs
counts or bounds reads only those columns. Phrases are intersections of shifted arrays.

A search for the best chunks adds up the bounds by bucket, scores the most promising
buckets, and then just those others whose bound reaches the score that is last among
the best so far; the rest can't hold any of the best and isn't read.

Segments never change. An update writes its chunks as a new segment and the places of
removed ones as a list; segments of like size are merged when there are many, without what
was removed, and no text is cut into terms again. A commit, a small file, names what is live. There is
one writer at a time; readers keep the commit they opened.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.query import Atom, Query, atoms
from ..functions.stem import porter1
from ..sources import store
from .search import B, COLUMNS, K1, _atom_terms, matches

#: Changes whenever terms would come out otherwise; an index of another version is built anew.
VERSION = "4"
BUCKET = 64
#: Bytes of a file's blocks in memory, where one task sorts them; smaller indexes have a few smaller files, for their tasks.
FILE_BYTES, SMALL_FILE = 256 << 20, 16 << 20
#: Bytes of a block in memory besides its occurrences.
BLOCK_BYTES = 112
#: So many segments of like size (a power of FANOUT) become one.
FANOUT = 8
#: Chunks, in whole buckets, that tell where files of blocks begin.
SAMPLE = 4096
#: Buckets whose bounds the driver holds; beyond that they stay a table.
LOCAL = 4096
#: Postings that are scored without choosing among their buckets.
FEW = 1 << 16
#: Ids whose texts can be asked for at once.
MOST_TEXTS = 600
NAMES = [c for c, _, _ in COLUMNS]
KEY = ["home", "bucket"]
BLOCKS = "home int, bucket long, term string, n int, best double, at array<int>"
#: A number in ``at``: the spot, two bits of column, then the position. Column LONG has the chunk's length in terms instead.
SPOT, COLUMN = 22, 20
LONG = len(NAMES)
PLACES = 1 << COLUMN
AT, SPOTS = 31, (1 << 31 - SPOT) - 1
FOUND = "chunk_id string, file_id string, chunk_index int, bm25 double, match_source int, home int, bucket long"


def _terms(tokenizer: str):
    """Two functions: a text's words in order, and the terms of distinct words (None: the words themselves)."""
    import regex

    if tokenizer == "simple":
        run, plain = regex.compile(r"[\p{L}\p{N}]+"), re.compile("[0-9a-z]+")
        return lambda text: (plain if text.isascii() else run).findall(text.lower()) if text else [], None
    return lambda text: X.folded_words(X.split_bigrams(text)), lambda words: [porter1(w) for w in words]


# -- blocks ---------------------------------------------------------------------------


def _values(strings: pa.Array) -> list[str]:
    """An Arrow array's strings; ``to_pylist`` makes an object more for each."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _encode(home: np.ndarray, bucket: np.ndarray, spot: np.ndarray, columns: list[list], cut, stem, average: float, deal, arrow: pa.Schema) -> pa.RecordBatch:
    """The blocks of some rows. The empty term holds each bucket's rows, with their lengths only.

    An occurrence is one number, of group, term and what ``at`` holds; so all are in order after one sort.
    """
    rows, wide = len(spot), len(columns)
    found, sizes = [""], []
    for r in range(rows):
        for texts in columns:
            words = cut(texts[r])
            sizes.append(len(words))
            found += words
    plain = pa.array(found, pa.string()).dictionary_encode()
    terms, ids = plain.dictionary, plain.indices.to_numpy()[1:].astype(np.int64)  # the empty one first
    known = _values(terms)
    if stem:
        stems = pa.array(stem(known), pa.string()).dictionary_encode()
        terms, ids = stems.dictionary, stems.indices.to_numpy()[ids].astype(np.int64)
        known = _values(terms)
    sizes = np.array(sizes, np.int64)
    cell = np.repeat(np.arange(rows * wide), sizes)
    place = np.arange(len(cell)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    longs = sizes.reshape(rows, wide).sum(1)
    if longs.max() >= PLACES:
        raise ValueError(f"a chunk of {longs.max()} terms; the most is {PLACES - 1}")
    change = np.r_[True, (np.diff(bucket) != 0) | (np.diff(home) != 0)]
    group, heads = np.cumsum(change) - 1, np.flatnonzero(change)
    wide_term = max(1, (len(terms) - 1).bit_length())
    long_of = np.zeros((len(heads), BUCKET), np.int64)
    long_of[group, spot] = longs
    row = cell // wide
    each = (group[row] << wide_term | ids) << AT | spot[row] << SPOT | cell % wide << COLUMN | place
    each.sort()
    # Occurrences; then, of every term and of none, the length of each chunk that has it.
    own = each[np.flatnonzero(np.r_[True, np.diff(each >> SPOT) != 0])] if len(each) else each
    own = np.append(own >> SPOT, group << wide_term + AT - SPOT | spot)
    each = np.append(each, own << SPOT | LONG << COLUMN | long_of[own >> wide_term + AT - SPOT, own & SPOTS])
    each.sort()
    start, first = np.flatnonzero(np.r_[True, np.diff(each >> SPOT) != 0]), np.flatnonzero(np.r_[True, np.diff(each >> AT) != 0])
    weight = np.array([w for _, w, _ in COLUMNS] + [0.0])
    frequency, posting = np.add.reduceat(weight[each >> COLUMN & 3], start), each[start] >> SPOT
    score = frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * long_of[posting >> wide_term + AT - SPOT, posting & SPOTS] / average))
    block = np.searchsorted(start, first)
    ends = pa.array(np.append(first, len(each)), pa.int32())
    at = pa.ListArray.from_arrays(ends, pa.array((each & (1 << AT) - 1).astype(np.int32)))
    head, term = heads[each[first] >> wide_term + AT], each[first] >> AT & (1 << wide_term) - 1
    made = [home[head], bucket[head], terms.take(pa.array(term)), np.diff(np.append(block, len(start))), np.maximum.reduceat(score, block), at, deal(known, term, bucket[head])]
    return pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)


def _dealer(lows: list[str]):
    """The file of each block: the last that begins with its term or before it; a term that several files begin with is dealt by bucket."""

    own_of = {t: lows.count(t) for t in set(lows)}

    def deal(terms: list[str], term: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        last = np.array([bisect_right(lows, t) for t in terms], np.int64) - 1
        own = np.array([own_of.get(t, 1) for t in terms], np.int64)
        return last[term] - bucket % own[term]

    return deal


def _cuts(weights: list[tuple[str, int]], files: int) -> list[str]:
    """First terms of ``files`` files, about, of like weight, from terms in order and their weights; a heavy term begins several."""
    share, lows, held = sum(w for _, w in weights) / files, [""], 0.0
    for term, w in weights:
        parts = round(w / share) if share else 0
        if parts > 1:
            lows += [term] * (parts - (term == ""))
            held = share  # the next one begins a file
        else:
            if held and held + w > share and term:
                lows.append(term)
                held = 0.0
            held += w
    return lows


def encode(docs: DataFrame, tokenizer: str, average: float, lows: list[str] = [""]) -> DataFrame:
    """Blocks of stored chunks (home, bucket, spot and the indexed columns) and the file ``r`` of each, out of those that begin with ``lows``; each chunk is read once.

    ``best`` is the score at an average length of ``average``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(f"{BLOCKS}, r int"))

    def run(batches):
        (cut, stem), deal = _terms(tokenizer), _dealer(lows)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(1).to_numpy()
            # Cuts between buckets; one that Arrow has cut gives two blocks a term, which counts the same.
            edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, batch.num_rows]
            cuts = edges[::8] if (len(edges) - 1) % 8 == 0 else np.append(edges[::8], batch.num_rows)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(low, high - low)
                yield _encode(part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy(), part.column(2).to_numpy().astype(np.int64), [part.column(k).to_pylist() for k in range(3, part.num_columns)], cut, stem, average, deal, arrow)

    return docs.select(*KEY, "spot", *NAMES).mapInArrow(run, f"{BLOCKS}, r int")


def _spot(x: Column) -> Column:
    return F.shiftright(x, SPOT)


def _column(x: Column) -> Column:
    return F.shiftright(x, COLUMN).bitwiseAND(3)


def _place(x: Column) -> Column:
    return x.bitwiseAND(PLACES - 1)


def _frequency(get) -> Column:
    return reduce(lambda a, b: a + b, [get(f"n_{c}") * F.lit(w) for c, w, _ in COLUMNS])


def _part(f: Column, long: Column, average: float) -> Column:
    """What occurrences add to a chunk's score, before the term's weight."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * long / F.lit(average)))


# -- the index ----------------------------------------------------------------------


@dataclass
class Segment:
    number: int
    chunks: int
    terms: int
    average: float  # terms a chunk for which ``best`` was computed
    lows: list[str] = field(default_factory=list)  # first term of each file; several files may begin with the same
    gone_chunks: int = 0
    gone_terms: int = 0


class Index:
    """A stored index: ``ensure`` opens or makes one, ``update`` changes it."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = "porter"):
        self.spark, self.tokenizer, self.home = spark, tokenizer, f"{path}/version={VERSION}-{tokenizer}"
        self.told: dict[str, int] = {}  # buckets and postings of the last ``top``
        self._open_commit()

    def _open_commit(self) -> None:
        numbers = [int(n[7:-5]) for n in store.names(self.spark, self.home) if n.startswith("commit-") and n.endswith(".json")]
        self.commit = max(numbers, default=-1)
        held = json.loads(store.read_text(self.spark, f"{self.home}/commit-{self.commit}.json")) if numbers else {"next": 0, "segments": [], "gone": []}
        self.next, self.gone = held["next"], held["gone"]
        self.segments = [Segment(**s) for s in held["segments"]]
        self.rows = sum(s.chunks - s.gone_chunks for s in self.segments)
        total = sum(s.terms - s.gone_terms for s in self.segments)
        self.average = total / self.rows if self.rows and total else 1.0
        self._frames: dict[str, DataFrame | None] = {}
        self._paths: dict[int, dict[int, list[str]]] = {}

    def _save(self, segments: list[Segment], gone: list[int]) -> None:
        """The new commit; the one before stays for its readers, older ones go."""
        text = json.dumps({"next": self.next, "segments": [asdict(s) for s in segments], "gone": gone})
        store.write_text(self.spark, f"{self.home}/commit-{self.commit + 1}.json", text)
        store.delete(self.spark, f"{self.home}/commit-{self.commit - 1}.json")
        self._open_commit()

    # -- what is stored

    def _stored(self, name: str) -> DataFrame:
        """The live segments' part of a table, with ``seg``."""
        if name not in self._frames:
            paths = [f"{self.home}/{name}/seg={s.number}" for s in self.segments]
            self._frames[name] = self._reader(name).parquet(*paths)
        return self._frames[name]

    def _reader(self, name: str):
        reader = self.spark.read.option("basePath", f"{self.home}/{name}")
        return reader.schema(f"{BLOCKS}, seg int") if name == "blocks" else reader

    def _files(self, number: int) -> dict[int, list[str]]:
        """The paths of a segment's files of blocks: they are numbered as the tasks that wrote them."""
        if number not in self._paths:
            out: dict[int, list[str]] = {}
            for n in store.names(self.spark, f"{self.home}/blocks/seg={number}"):
                if n.startswith("part-"):
                    out.setdefault(int(n.split("-")[1]), []).append(f"{self.home}/blocks/seg={number}/{n}")
            self._paths[number] = out
        return self._paths[number]

    def _dead(self) -> DataFrame | None:
        """(home, bucket, dead): places of removed chunks; None if there are none."""
        if "gone" not in self._frames:
            parts = [f"{self.home}/gone/part={n}" for n in self.gone]
            self._frames["gone"] = self.spark.read.parquet(*parts).groupBy(*KEY).agg(F.collect_set("spot").alias("dead")) if parts else None
        return self._frames["gone"]

    def _alive(self, blocks: DataFrame) -> DataFrame:
        dead = self._dead()
        return blocks.withColumn("dead", F.lit(None).cast("array<int>")) if dead is None else blocks.join(dead, KEY, "left")

    @property
    def chunks(self) -> DataFrame:
        """All live chunks, as they were given."""
        docs = self._stored("docs") if self.segments else None
        if docs is None:
            return self.spark.createDataFrame([], "file_id string, chunk_index int, chunk_id string, text string, filename string, folder_path string")
        alive = self._alive(docs).where(~F.coalesce(F.array_contains("dead", F.col("spot")), F.lit(False)))
        return alive.drop("dead", "spot", "seg", *KEY)

    def blocks(self, term: str, prefix: bool = False) -> DataFrame:
        """The blocks of a term, or of all terms that go on from it: a range of each segment's files."""
        last = term + chr(0x10FFFF) if prefix else term
        paths: list[str] = []
        for s in self.segments:
            low = max(0, bisect_left(s.lows, term) - 1)
            high = (bisect_left if prefix else bisect_right)(s.lows, last) - 1
            if low == 0 and high == len(s.lows) - 1:
                paths.append(f"{self.home}/blocks/seg={s.number}")
            else:
                paths += [p for r in range(low, high + 1) for p in self._files(s.number).get(r, ())]
        if not paths:
            return self.spark.createDataFrame([], f"{BLOCKS}, seg int")
        return self._reader("blocks").parquet(*paths).where(F.col("term").startswith(term) & (F.col("term") != "") if prefix else F.col("term") == term)

    def dictionary(self, prefix: str = "") -> DataFrame:
        """FTS3: (term, df, blocks) of the terms that begin so, from block counts alone; removed chunks count until their segment is merged."""
        return self.blocks(prefix, True).groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks"))

    def _live(self, blocks: DataFrame) -> DataFrame:
        """Blocks without the occurrences in removed chunks; ``n`` counts them no longer."""
        if self._dead() is None:
            return blocks
        left = F.filter("at", lambda x: ~F.array_contains("dead", _spot(x)))
        at = F.when(F.col("dead").isNull(), F.col("at")).otherwise(left)
        met = self._alive(blocks).withColumn("at", at).withColumn("n", F.when(F.col("dead").isNull(), F.col("n")).otherwise(F.size(F.filter("at", lambda x: _column(x) == LONG))))
        return met.where("n > 0").drop("dead")

    @staticmethod
    def _counted(blocks: DataFrame, *more: str) -> DataFrame:
        """(home, bucket, spot, more..., long, n_...) from rows with ``at``; rows of a bucket have to be in one partition already, or are shuffled."""
        each = blocks.select(*KEY, *more, F.explode("at").alias("x"))
        counts = [F.count_if(_column(F.col("x")) == k).cast("int").alias(f"n_{c}") for k, c in enumerate(NAMES)]
        long = F.max(F.when(_column(F.col("x")) == LONG, _place(F.col("x")))).alias("long")
        return each.groupBy(*KEY, _spot(F.col("x")).alias("spot"), *more).agg(long, *counts)

    def postings(self, blocks: DataFrame) -> DataFrame:
        """One row per live chunk and term: home, bucket, spot, term, long, n_...; a posting lies in one block, so nothing is shuffled."""

        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    at = part.column(3)
                    x, sizes = at.flatten().to_numpy(), np.diff(at.offsets.to_numpy())
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    start = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(x >> SPOT) != 0)][: len(x)])
                    if not len(start):
                        continue
                    column, own = x >> COLUMN & 3, pa.array(row[start])
                    counts = [np.add.reduceat((column == k).astype(np.int32), start) for k in range(LONG)]
                    long = np.maximum.reduceat(np.where(column == LONG, x & PLACES - 1, 0), start)
                    yield pa.RecordBatch.from_arrays([*[part.column(k).take(own) for k in range(2)], pa.array(x[start] >> SPOT, pa.int32()), part.column(2).take(own), *[pa.array(v, pa.int32()) for v in (long, *counts)]], names=["home", "bucket", "spot", "term", "long", *[f"n_{c}" for c in NAMES]])

        live = self._live(blocks.select(*KEY, "term", "n", "at"))
        return live.select(*KEY, "term", "at").mapInArrow(run, "home int, bucket long, spot int, term string, long int, " + ", ".join(f"n_{c} int" for c in NAMES))

    # -- changes

    def _write(self, dealt: DataFrame, number: int, average: float, lows: list[str] | None = None) -> Segment:
        """The blocks of a new segment, sorted; its chunks are there. ``dealt`` has a partition a file; ``lows`` are their first terms, where they are known."""
        spark, out = self.spark, f"{self.home}/blocks/seg={number}"
        # The term comes first: a sort by what is the same in all rows compares whole rows each time.
        dealt.sortWithinPartitions("term", *KEY).write.mode("overwrite").parquet(out)
        made = spark.read.schema(BLOCKS).parquet(out)
        longs = F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + _place(x))
        told = made.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(longs), F.lit(0)).alias("terms")).first()
        if lows is None:
            own = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int").alias("r")
            first = {r["r"]: r["low"] for r in made.groupBy(own).agg(F.min("term").alias("low")).collect()} if told["n"] else {}  # a row a file
            known = sorted(first)
            # A file without rows begins where the next one does.
            lows = [next((first[k] for k in known if k >= r), "") for r in range(max(known, default=-1) + 1)]
        return Segment(number, told["n"], told["terms"], average, lows)

    def _files_of(self, size: int) -> int:
        """How many files blocks of so many bytes in memory make."""
        return int(max(1, size // FILE_BYTES, min(self.spark.sparkContext.defaultParallelism, size // SMALL_FILE)))

    def _new(self, chunks: DataFrame) -> Segment:
        number, self.next = self.next, self.next + 1
        place = f"{self.home}/docs/seg={number}"
        kept = [F.col(c) for c in chunks.columns]
        # Like lengths share a bucket, which makes its bounds tight.
        ordered = chunks.sortWithinPartitions(F.length("text")).withColumn("_n", F.monotonically_increasing_id())
        ordered.select(F.lit(number).alias("home"), F.expr(f"_n div {BUCKET}").alias("bucket"), (F.col("_n") % BUCKET).cast("int").alias("spot"), *kept).write.mode("overwrite").parquet(place)
        docs = self.spark.read.parquet(place)
        rows = docs.count()
        times = max(1, rows // SAMPLE)
        picked = F.pmod(F.hash(*KEY), F.lit(times)) == 0
        some = encode(docs.where(picked), self.tokenizer, 1.0)
        size, every = F.lit(BLOCK_BYTES) + 4 * F.size("at"), F.col("term") == ""
        longs = F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + _place(x))
        found = some.groupBy("term").agg(F.sum(size).alias("size"), F.sum(F.when(every, F.col("n"))).alias("n"), F.sum(F.when(every, longs)).alias("terms")).collect()  # the terms of a bounded sample
        all_ = next((r for r in found if r["term"] == ""), None)
        # Terms a chunk, by how long the sample is beside all; bounds only get looser where it is off.
        wide = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in NAMES])
        told = docs.agg(F.sum(wide).alias("all"), F.sum(F.when(picked, wide)).alias("some")).first()
        average = all_["terms"] / told["some"] * told["all"] / rows if all_ and all_["terms"] else 1.0
        lows = _cuts(sorted((r["term"], r["size"]) for r in found), self._files_of(sum(r["size"] for r in found) * times))
        return self._write(encode(docs, self.tokenizer, average, lows).repartitionById(len(lows), "r").drop("r"), number, average, lows)

    def update(self, fresh: DataFrame | None = None, gone: DataFrame | None = None, by: str = "file_id") -> None:
        """SNK13: one commit that removes the chunks whose ``by`` is in ``gone`` and adds those of ``fresh``.

        What is written follows the change: a segment of the fresh chunks, the places of the
        removed ones, and now and then the merge of segments of like size.
        """
        segments, parts = [Segment(**asdict(s)) for s in self.segments], list(self.gone)
        if gone is not None and segments:
            number, self.next = self.next, self.next + 1
            out = f"{self.home}/gone/part={number}"
            docs = self._alive(self._stored("docs").select(*KEY, "spot", "seg", by)).where(~F.coalesce(F.array_contains("dead", F.col("spot")), F.lit(False)))
            found = docs.join(gone.select(by).distinct(), by, "left_semi").select(*KEY, "spot", "seg")
            found.write.mode("overwrite").parquet(out)
            lost = self.spark.read.parquet(out)
            longs = self.blocks("").select(*KEY, F.explode("at").alias("x")).select(*KEY, _spot(F.col("x")).alias("spot"), _place(F.col("x")).alias("long"))
            for r in lost.join(longs, [*KEY, "spot"]).groupBy("seg").agg(F.count("*").alias("n"), F.sum("long").alias("terms")).collect():  # a row a segment
                own = next(s for s in segments if s.number == r["seg"])
                own.gone_chunks += r["n"]
                own.gone_terms += r["terms"]
            parts.append(number)
        if fresh is not None:
            made = self._new(fresh)
            if made.chunks:
                segments.append(made)
        self._save(segments, parts)
        self._merge()

    def _merge(self) -> None:
        """Segments of one tier become one where there are FANOUT of them; a segment that lost half its chunks is written anew too."""
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in self.segments:
                tiers.setdefault(int(np.log(max(1, s.chunks - s.gone_chunks)) / np.log(FANOUT)), []).append(s)
            due = next((t for t in tiers.values() if len(t) >= FANOUT), None) or [s for s in self.segments if s.gone_chunks * 2 > s.chunks][:1]
            if not due:
                break
            self._join(due)
        if self.gone and not any(s.gone_chunks for s in self.segments):
            self._save(self.segments, [])
        wanted = {f"seg={s.number}" for s in self.segments}
        before = {f"seg={s['number']}" for s in json.loads(store.read_text(self.spark, f"{self.home}/commit-{self.commit - 1}.json"))["segments"]} if self.commit > 0 else set()
        for name in ("docs", "blocks"):
            for part in store.names(self.spark, f"{self.home}/{name}"):
                if part.startswith("seg=") and part not in wanted | before:
                    store.delete(self.spark, f"{self.home}/{name}/{part}")

    def _join(self, due: list[Segment]) -> None:
        """One segment out of several: their live chunks and postings, which keep their places."""
        number, self.next = self.next, self.next + 1
        own = F.col("seg").isin([s.number for s in due])
        docs = self._alive(self._stored("docs").where(own)).where(~F.coalesce(F.array_contains("dead", F.col("spot")), F.lit(False)))
        docs.drop("dead", "seg").write.mode("overwrite").parquet(f"{self.home}/docs/seg={number}")
        average = max(s.average for s in due)
        blocks = self._live(self._stored("blocks").where(own)).withColumn("best", F.col("best") * self._rise(average))
        blocks.drop("seg").write.mode("overwrite").parquet(f"{self.home}/raw/seg={number}")
        raw = self.spark.read.schema(BLOCKS).parquet(f"{self.home}/raw/seg={number}")
        size = raw.agg(F.coalesce(F.sum(F.lit(BLOCK_BYTES) + 4 * F.size("at")), F.lit(0)).alias("size")).first()["size"]
        made = self._write(raw.repartitionByRange(self._files_of(size), "term", *KEY), number, average)
        store.delete(self.spark, f"{self.home}/raw/seg={number}")
        gone = {s.number for s in due}
        self._save([s for s in self.segments if s.number not in gone] + ([made] if made.chunks else []), self.gone)

    def _rise(self, average: float) -> Column:
        """How much larger than ``best`` a score can be at another average length: at most as the average rises."""
        return reduce(lambda out, s: out.when(F.col("seg") == s.number, max(1.0, average / s.average)), self.segments, F.when(F.lit(False), 1.0))

    # -- searches

    @staticmethod
    def _only(rows: DataFrame, only) -> DataFrame:
        """``rows`` of some buckets: a short list of (home, bucket), or a table of them."""
        if only is None:
            return rows
        if isinstance(only, DataFrame):
            return rows.join(only, KEY, "left_semi")
        per: dict[int, list[str]] = {}
        for home, bucket in only:
            per.setdefault(home, []).append(str(bucket))
        return rows.where(" OR ".join(f"home = {h} AND bucket IN ({', '.join(b)})" for h, b in per.items()) or "false")

    def _occurrences(self, atom: Atom, parts: list[str], only=None, whole: bool = False) -> DataFrame:
        """(home, bucket, at) of the buckets where an atom occurs: its occurrences, and the lengths of the chunks that have it; ``whole``: one row a bucket."""
        found = []
        for k, t in enumerate(parts):
            open_end = atom.prefix and k == len(parts) - 1
            rows = self._live(self._only(self.blocks(t, open_end).select(*KEY, "n", "at"), only)).select(*KEY, "at")
            if whole or len(parts) > 1:
                rows = rows.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
            found.append(rows)
        if len(found) == 1:
            return found[0]
        met = found[0]
        for k, rows in enumerate(found[1:], 1):
            met = met.join(rows.select(*KEY, _starts(k).alias(f"at_{k}")), KEY)
        begins = reduce(F.array_intersect, [F.col(f"at_{k}") for k in range(1, len(found))], F.filter("at", lambda x: _column(x) != LONG))
        met = met.select(*KEY, "at", begins.alias("begins")).where(F.size("begins") > 0).withColumn("spots", F.transform("begins", _spot))
        return met.select(*KEY, F.concat("begins", F.filter("at", lambda x: (_column(x) == LONG) & F.array_contains("spots", _spot(x)))).alias("at"))

    def _asked(self, query: Query) -> list[tuple[int, Atom, list[str]]]:
        return [(i, a, parts) for i, a in enumerate(atoms(query)) if (parts := _atom_terms(a, self.tokenizer))]

    def frequencies(self, query: Query) -> dict[int, int]:
        """AGG24: how many live chunks each atom occurs in. For terms that is added up from block counts."""
        counts = []
        for i, atom, parts in self._asked(query):
            if len(parts) == 1 and not atom.prefix:
                rows = self.blocks(parts[0])
                rows = rows.select("n") if self._dead() is None else self._live(rows.select(*KEY, "n", "at"))
            else:
                rows = self._occurrences(atom, parts, None, True).select(F.size(F.filter("at", lambda x: _column(x) == LONG)).alias("n"))
            counts.append(rows.select(F.lit(i).alias("atom"), F.col("n").cast("long").alias("n")))
        return {r["atom"]: r["n"] for r in reduce(DataFrame.unionByName, counts).groupBy("atom").agg(F.sum("n").alias("n")).collect()} if counts else {}  # a row an atom

    def _weight(self, df: int) -> float:
        return max(1e-6, float(np.log((self.rows - df + 0.5) / (df + 0.5))))

    def _scored(self, query: Query, df: dict[int, int], only=None) -> DataFrame:
        """(home, bucket, spot, bm25, match_source) of the matching chunks."""
        asked = self._asked(query)
        rows = reduce(DataFrame.unionByName, [self._occurrences(a, parts, only).withColumn("atom", F.lit(i)) for i, a, parts in asked])
        hits = self._counted(rows.repartition(*KEY), "atom")  # one shuffle, of blocks
        weight = reduce(lambda out, i: out.when(F.col("atom") == i, self._weight(df[i])), df, F.when(F.lit(False), 0.0))
        part = weight * _part(_frequency(F.col), F.col("long"), self.average)
        source = reduce(lambda a, b: a.bitwiseOR(b), [F.max(F.when(F.col(f"n_{c}") > 0, bit).otherwise(0)) for c, _, bit in COLUMNS])
        per = hits.withColumn("part", part).groupBy(*KEY, "spot").agg(F.sum("part").alias("bm25"), source.alias("match_source"), F.collect_set("atom").alias("have"))
        have = {a: F.array_contains("have", i) for i, a in enumerate(atoms(query))}
        return per.where(matches(query, have)).drop("have")

    def _told(self, scored: DataFrame, only=None) -> DataFrame:
        docs = self._only(self._stored("docs"), only).select(*KEY, "spot", "chunk_id", "file_id", "chunk_index")
        return scored.join(docs, [*KEY, "spot"]).select("chunk_id", "file_id", "chunk_index", "bm25", "match_source", *KEY)

    def search(self, query: Query) -> DataFrame:
        """FTS2-FTS7, AGG24: all matching chunks (chunk_id, file_id, chunk_index, bm25, match_source, home, bucket), scored as ``operators.search.bm25`` does. Only the query's own blocks are read."""
        df = self.frequencies(query)
        return self._told(self._scored(query, df)) if df else self.spark.createDataFrame([], FOUND)

    def bounds(self, query: Query, df: dict[int, int]) -> DataFrame:
        """(home, bucket, bound, n): for buckets that may match, the most that a chunk there can score, and the postings there; reads no postings."""
        asked, cap = self._asked(query), K1 + 1
        words, rise = [], self._rise(self.average)
        for i, atom, parts in asked:
            for k, t in enumerate(parts):
                rows = self.blocks(t, atom.prefix and k == len(parts) - 1)
                words.append(rows.select(*KEY, (F.col("best") * rise).alias("best"), "n", F.lit(i).alias("atom"), F.lit(k).alias("word")))
        per = reduce(DataFrame.unionByName, words)
        names = {(i, k): f"b{i}_{k}" for i, _, parts in asked for k in range(len(parts))}
        # A prefix has several terms; what they add together is at most the sum.
        own = [F.sum(F.when((F.col("atom") == i) & (F.col("word") == k), F.col("best"))).alias(n) for (i, k), n in names.items()]
        met = per.groupBy(*KEY).agg(*own, F.sum("n").alias("n"))
        have = {a: F.lit(False) for a in atoms(query)}
        bound = F.lit(0.0)
        for i, atom, parts in asked:
            each = [F.col(names[i, k]) for k in range(len(parts))]
            have[atom] = reduce(lambda a, b: a & b, [c.isNotNull() for c in each])
            least = F.least(F.lit(cap), *each)
            bound = bound + F.when(have[atom], least * self._weight(df.get(i, 0))).otherwise(0.0)
        return met.where(matches(query, have)).select(*KEY, bound.alias("bound"), "n")

    def top(self, query: Query, k: int, digits: int | None = None, few: int = FEW) -> DataFrame:
        """TOP1: the best ``k`` chunks of ``search``, by bm25 (rounded to ``digits``), then chunk_id; only the blocks of buckets that may hold one are read.

        Where the postings that may match are ``few``, they are all scored at once, which costs less than choosing.
        """
        df = self.frequencies(query)
        if not df:
            return self.spark.createDataFrame([], FOUND)
        bounds = self.bounds(query, df)
        near = bounds.orderBy(F.desc("bound"), *KEY).limit(LOCAL + 1).collect()
        slack = 1e-9 + (10.0**-digits if digits is not None else 0.0)

        def rounded(rows):
            return rows if digits is None else rows.withColumn("bm25", F.round("bm25", digits))

        first = [(r["home"], r["bucket"]) for r in near[:k]]
        last = float("-inf")
        if len(near) > k and sum(r["n"] for r in near) > few:
            best = self._scored(query, df, first).orderBy(F.desc("bm25")).limit(k).select("bm25").collect()
            last = best[-1]["bm25"] - slack if len(best) == k else last
        if len(near) <= LOCAL or near[-1]["bound"] < last:
            only = [(r["home"], r["bucket"]) for r in near if r["bound"] >= last]
            only = None if len(only) == len(near) else only
            self.told = {"buckets": len(near), "read": len(near if only is None else only), "postings": sum(r["n"] for r in near), "postings_read": sum(r["n"] for r in near if r["bound"] >= last)}
        else:
            only = bounds.where(F.col("bound") >= last).select(*KEY)
            self.told = {}
        out = rounded(self._told(self._scored(query, df, only), only)).orderBy(F.desc("bm25"), "chunk_id").limit(k)
        out._candidates_bounded = True
        return out

    def texts(self, hits: list[tuple[str, int]]) -> DataFrame:
        """The stored chunks of a few (chunk_id, bucket): only their buckets are read."""
        if len(hits) > MOST_TEXTS:
            raise ValueError(f"{len(hits)} chunks asked for, at most {MOST_TEXTS} can be")
        return self._stored("docs").where(F.col("bucket").isin(sorted({b for _, b in hits})) & F.col("chunk_id").isin([c for c, _ in hits]))


def _starts(k: int) -> Column:
    """Where a phrase would begin whose k-th word (from 0) occurs ``at``."""
    return F.transform(F.filter("at", lambda x: (_column(x) != LONG) & (_place(x) >= k)), lambda x: x - k)


def build(chunks: DataFrame, path: str, tokenizer: str = "porter") -> None:
    """A new index of all ``chunks`` below ``path``; the commit comes last and tells that all is there."""
    own = Index(chunks.sparkSession, path, tokenizer)
    own.next = 0
    made = own._new(chunks)
    own._save([made] if made.chunks else [], [])


def ensure(spark: SparkSession, path: str, chunks, tokenizer: str = "porter") -> Index:
    """SNK12: the index below ``path``, built first where it is missing, half done or of another version, which then goes.

    ``chunks`` is called for the chunk table only if it has to be built.
    """
    own = f"version={VERSION}-{tokenizer}"
    if not any(n.startswith("commit-") for n in store.names(spark, f"{path}/{own}")):
        build(chunks(), path, tokenizer)
        for name in store.names(spark, path):
            if name != own and name.endswith(f"-{tokenizer}"):
                store.delete(spark, f"{path}/{name}")
    return Index(spark, path, tokenizer)


def synced(stored: DataFrame, changes: DataFrame, key: str = "id", columns: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """SNK13: an index of mails (key, terms) after their ``changes`` (key, op: insert, update or delete; the columns): deleted and changed ones go, new texts come in."""
    gone = stored.join(changes.select(key).distinct(), key, "left_anti")
    fresh = changes.where(F.lower("op").isin("insert", "update")).select(key, X.terms(F.concat_ws(" ", *columns), "simple").alias("terms"))
    return gone.select(key, "terms").unionByName(fresh)
