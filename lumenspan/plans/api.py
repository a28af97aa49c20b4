"""The engine's calls: search, contents, listing, lookups, status, quick search, clicks, telemetry, job control (API1-API7, API9, SNK11, SNK15, FLT16, FTS15, FN32, FN33)."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words
from ..functions.query import is_stop, remove_stop_words, tokens
from ..operators import catalogue as C
from ..operators import chunks as K
from ..operators import dense as D
from ..operators import feedback as B
from ..operators import index as I
from ..operators import results as R
from ..operators import search as S

#: Seconds that a search's result may be shown again, and how many are kept before all go.
CACHE_SECONDS, CACHE_ENTRIES = 30.0, 10
#: Seconds within which a new search makes the last click a bounce.
BOUNCE_SECONDS = 10.0
MOST_PATHS = 900


@dataclass
class Engine:
    """Files, chunks and, where there are such, embeddings and clicks as tables; ``as_of`` stands for now.

    ``index`` is a stored index of the chunks: with it a search reads only its terms'
    postings, without it the chunks are scanned. ``embed`` turns a query into a vector;
    without it every search is by keywords. Modes are Fast (keywords) and Smart (fused
    with vectors where they cover enough); a mode of another name is Smart.
    """

    files: DataFrame
    chunks: DataFrame
    as_of: Column
    embeddings: DataFrame | None = None
    clicks: DataFrame | None = None
    embed: object = None
    mode: str = "Smart"
    tokenizer: str = "porter"
    index: I.Index | None = None
    clock: Callable[[], float] = time.monotonic
    _cache: dict = field(default_factory=dict)
    _coverage: tuple | None = None
    _recorded: dict = field(default_factory=dict)
    _last: tuple | None = None
    _counters: dict = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _mode(self) -> str:
        return "Fast" if self.mode.lower() == "fast" else "Smart"

    def hits(self, query: str, options: S.Options) -> DataFrame:
        """API5: ranked files; mode Smart fuses with vectors where they cover enough, else keywords decide."""
        boosts = None if self.clicks is None else B.boosts(self.clicks, query)
        found = S.search(self.index or self.chunks, self.files, query, self.as_of, options, boosts)
        if self._mode() != "Smart" or self.embed is None or not self._covered():
            return found.withColumn("bm25_score", F.col("score")).withColumn("dense_score", F.lit(0.0))
        from pyspark.sql import Window

        # At most options.top rows are ranked in one task.
        ranked = found.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))
        near = D.rerank(ranked, self.embeddings.select("file_id", "chunk_index", "embedding"), list(self.embed(query)))
        fused = D.fuse(ranked.select("file_id", F.col("bm25_rank").alias("rank"), "score"), near.select("file_id", F.col("dense_rank").alias("rank"), F.col("similarity").alias("score")), options.top)
        out = found.drop("score").join(fused, "file_id").withColumnRenamed("hybrid_score", "score").withColumnRenamed("keyword_score", "bm25_score")
        return out.orderBy(F.desc("score"), "file_id")

    def _covered(self) -> bool:
        """Whether vectors cover enough; counted once, and again after ``refresh``."""
        if self.embeddings is None:
            return False
        if self._coverage is None:
            self._coverage = self.chunks.where(F.length("text") > 0).count(), self.embeddings.count()
        n, embedded = self._coverage
        return n > 0 and embedded / n >= D.LEAST_COVERAGE

    def refresh(self) -> None:
        """To be called when tables have changed: forgets results and counts."""
        self._cache.clear()
        self._coverage = None

    def search_files(self, query: str, top: int = 20, extensions: list[str] | None = None) -> dict:
        """API1: at most 100 items as plain values; a blank query is an error."""
        if not query or not query.strip():
            return {"error": "query is empty"}
        began = time.monotonic()
        # FTS15: every option is part of the key.
        key = (query, top, tuple(extensions or ()), self.mode, self.tokenizer)
        if key in self._cache and self.clock() - self._cache[key][0] < CACHE_SECONDS:
            return self._cache[key][1]
        options = S.Options(top=max(1, min(100, top)), extensions=tuple(extensions or ()), tokenizer=self.tokenizer)
        words = [t for t in tokens(query) if not is_stop(t)]
        hits = self.hits(query, options)
        if "text" not in hits.columns:
            # The search has run once then; at most 100 rows are kept.
            kept = hits.drop("home").collect()
            hits = self.files.sparkSession.createDataFrame(kept, hits.drop("home").schema)
            texts = self.index.texts([(r["chunk_id"], r["bucket"]) for r in kept])
            hits = hits.join(F.broadcast(texts.select("chunk_id", "filename", "text")), "chunk_id")
        rows = hits.orderBy(F.desc("score"), "file_id").withColumn("snippet", X.snippet(F.col("text"), words))
        rows = rows.select("file_id", "filename", "path", "extension", F.bround("score", 4).alias("score"), "snippet", R.match_names(F.col("match_source")).alias("source"), F.col("modified_at").cast("string").alias("modified"), F.col("dense_score")).collect()  # at most 100 rows
        items = [{"fileId": r["file_id"], "filename": r["filename"], "path": r["path"], "extension": r["extension"], "score": r["score"], "matchSnippet": r["snippet"], "matchSource": r["source"], "modifiedAt": r["modified"]} for r in rows]
        dense = sum(r["dense_score"] > 0 for r in rows)
        stats = {"bm25Count": len(rows), "denseCount": dense, "totalCandidates": len(rows), "finalCount": len(rows), "durationMs": int((time.monotonic() - began) * 1000)}
        out = {"query": query, "mode": self._mode(), "count": len(items), "items": items, "stats": stats}
        if len(self._cache) > CACHE_ENTRIES:
            self._cache.clear()
        self._cache[key] = (self.clock(), out)
        return out

    def get_file_content(self, file_id: str) -> dict:
        """API2"""
        if not file_id or not file_id.strip():
            return {"error": "fileId is empty"}
        file = self.files.where(F.col("file_id") == file_id).select("path", "filename", "extension").first()
        if file is None:
            return {"error": f"file not found: {file_id}"}
        got = K.file_content(self.chunks.where(F.col("file_id") == file_id)).first()
        if got is None:
            return {"message": "no content is indexed", "chunksAvailable": 0} | file.asDict()
        return {"content": got["content"], **file.asDict(), "chunksAvailable": got["n_chunks"], "truncated": got["truncated"]}

    def list_indexed_files(self, folder: str | None = None, extension: str | None = None, limit: int = 50) -> dict:
        """API3"""
        some = C.listing(self.files, folder, extension, limit)
        n = self.chunks.join(F.broadcast(some.select("file_id")), "file_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("n"))  # at most 200 ids
        rows = some.join(n, "file_id", "left").orderBy(F.desc("modified_at"), "path").collect()
        files = [{"id": r["file_id"], "filename": r["filename"], "path": r["path"], "extension": r["extension"], "sizeBytes": r["size_bytes"], "modifiedAt": str(r["modified_at"]), "extractStatus": r["extract_status"], "chunkCount": r["n"] or 0} for r in rows]
        return {"count": len(files), "files": files}

    def find(self, file_id: str | None = None, path: str | None = None) -> dict | None:
        """FLT16: a file by its id or path (case aside), or None."""
        own = F.col("file_id") == file_id if file_id is not None else F.lower("path") == (path or "").lower()
        row = self.files.where(own).limit(1).first()
        return row.asDict() if row else None

    def exists(self, path: str) -> bool:
        """FLT16"""
        return self.find(path=path) is not None

    def stamps(self) -> DataFrame:
        """SNK11, STR8: the status row, computed from the tables, so an interrupted run leaves nothing to recover."""
        f = C.totals(self.files)
        c = self.chunks.agg(F.count("*").alias("chunks"), F.count_if(F.length("text") > 0).alias("embeddable"))
        e = F.lit(0).cast("long") if self.embeddings is None else None
        out = f.crossJoin(c)  # one row each
        out = out.withColumn("embedded", e) if e is not None else out.crossJoin(self.embeddings.agg(F.count("*").alias("embedded")))
        return out.withColumn("indexing_percent", C.percent(F.col("indexed"), F.col("searchable"))).withColumn("embedding_percent", C.percent(F.col("embedded"), F.col("embeddable")))

    def stamp(self, path: str, phase: str, runs: int | None = None) -> DataFrame:
        """SNK11: writes the status row with its time, phase and number of automatic runs; each phase keeps its last one."""
        row = self.stamps().withColumn("phase", F.lit(phase)).withColumn("stamped_at", F.lit(datetime.now(UTC).isoformat())).withColumn("auto_runs", F.lit(runs or 0))
        row.write.mode("overwrite").parquet(f"{path}/phase={phase}")
        return self.files.sparkSession.read.option("basePath", path).parquet(path)

    def get_pipeline_status(self) -> dict:
        """API4"""
        r = self.stamps().first()
        last = self.files.agg(F.max("modified_at")).first()[0]
        return {"scanComplete": r["files"] > 0, "totalFiles": r["files"], "indexedFiles": r["indexed"], "totalChunks": r["chunks"], "embeddedChunks": r["embedded"], "embeddingComplete": r["embeddable"] > 0 and r["embedded"] >= r["embeddable"], "lastScanAt": str(last) if last else None, "lastIndexAt": str(last) if last else None}

    def quick_search(self, query: str, limit: int = 20) -> DataFrame:
        """API6"""
        return C.quick_search(self.files, query, limit)


    # -- clicks and telemetry (API9) --

    def record_click(self, query: str, path: str, position: int, at: float | None = None) -> None:
        """One more click on a path for a query; its place is the least seen."""
        key = remove_stop_words(query).lower().strip(), path.lower().rstrip("\\/")
        at = time.time() if at is None else at
        with self._lock:
            old = self._recorded.get(key, {"click_count": 0, "position": position, "is_bounce": False})
            self._recorded[key] = {"click_count": old["click_count"] + 1, "last_clicked": datetime.fromtimestamp(at, UTC).replace(tzinfo=None), "position": min(old["position"], position), "is_bounce": old["is_bounce"]}
            self._last = (*key, at)

    def on_new_search(self, query: str, at: float | None = None) -> bool:
        """Whether the search makes the last click a bounce: soon after it, and not by typing on."""
        new, at = remove_stop_words(query).lower().strip(), time.time() if at is None else at
        with self._lock:
            last, self._last = self._last, None
            if last is None:
                return False
            typed_on = bool(last[0]) and (new.startswith(last[0]) or last[0].startswith(new))
            bounced = not typed_on and at - last[2] <= BOUNCE_SECONDS
            if bounced:
                self._recorded[last[:2]]["is_bounce"] = True
            return bounced

    def recorded_clicks(self) -> DataFrame:
        """The clicks recorded here, as ``click_table`` has them, for an upsert by (query, path_key)."""
        rows = [(*k, v["click_count"], v["last_clicked"], v["position"], v["is_bounce"]) for k, v in sorted(self._recorded.items())]
        return self.files.sparkSession.createDataFrame(rows, "query string, path_key string, click_count long, last_clicked timestamp_ntz, position int, is_bounce boolean")

    def boost_batch(self, query: str, paths: list[str]) -> dict[str, float]:
        """Boosts of up to MOST_PATHS paths for a query, of recorded clicks and the clicks' table."""
        if len(paths) > MOST_PATHS:
            raise ValueError(f"more than {MOST_PATHS} paths; ask for them in parts")
        clicks = self.recorded_clicks() if self.clicks is None else self.clicks.select(*self.recorded_clicks().columns).unionByName(self.recorded_clicks())
        merged = clicks.groupBy("query", "path_key").agg(F.sum("click_count").alias("click_count"), F.min("position").alias("position"), F.max("is_bounce").alias("is_bounce"))
        keys = [p.lower().rstrip("\\/") for p in paths]
        return {r["path_key"]: r["click_boost"] for r in B.boosts(merged, query).where(F.col("path_key").isin(keys)).collect()}  # at most MOST_PATHS

    def record_search(self, mode: str, duration_ms: int, results: int) -> None:
        with self._lock:
            c = self._counters
            c["searches"] += 1
            c["empty"] += results == 0
            c["duration_ms"] += duration_ms
            c["samples"] += 1
            if mode in ("FtsOnly", "Dense", "Hybrid"):
                c[mode] += 1

    def record_top_click(self) -> None:
        with self._lock:
            self._counters["top_clicks"] += 1

    def snapshot(self) -> dict:
        """The counters as they stand, with the whole-number mean duration."""
        with self._lock:
            c = dict(self._counters)
        return c | {"mean_ms": c["duration_ms"] // c["samples"] if c["samples"] else 0}

    def acknowledge(self, sent: dict) -> None:
        """AGG20: takes a snapshot that has arrived off the counters; what came in meanwhile stays."""
        with self._lock:
            for k in COUNTERS:
                if k != "duration_ms":
                    self._counters[k] -= sent[k]
            done = self._counters["samples"] <= 0
            self._counters["samples"] = max(0, self._counters["samples"])
            self._counters["duration_ms"] = 0 if done else max(0, self._counters["duration_ms"] - sent["mean_ms"] * sent["samples"])


COUNTERS = ("searches", "empty", "duration_ms", "samples", "FtsOnly", "Dense", "Hybrid", "top_clicks")
PHASES = ("Idle", "Scanning", "Indexing", "DownloadingModel", "Embedding", "Paused", "Complete")


class Cycles:
    """API7: runs the ingest's steps, one cycle at a time: every so often, at once when asked, never while paused.

    ``steps`` are (phase, function) pairs; a failed step ends its cycle and is kept in ``error``.
    """

    def __init__(self, steps: list[tuple[str, Callable[[], object]]], every: float = 600.0):
        unknown = [p for p, _ in steps if p not in PHASES]
        if unknown:
            raise ValueError(f"no such phases: {unknown}")
        self.steps, self.every, self.phase, self.error, self.done = steps, every, "Idle", None, 0
        self._wake, self._go, self._stop, self._busy, self._thread = threading.Event(), threading.Event(), threading.Event(), threading.Lock(), None
        self._go.set()

    def run_cycle(self) -> bool:
        """One cycle now; False if one is running or the cycles are paused."""
        if not self._go.is_set() or not self._busy.acquire(blocking=False):
            return False
        try:
            self.error = None
            for phase, step in self.steps:
                while not self._go.is_set() and not self._stop.is_set():  # a pause takes effect between steps
                    self.phase = "Paused"
                    self._go.wait(0.05)
                self.phase = phase
                step()
            self.phase = "Complete"
            self.done += 1
            return True
        except Exception as e:
            self.error, self.phase = e, "Idle"
            return False
        finally:
            self._busy.release()

    def start(self) -> None:
        """Cycles in a thread of their own until ``stop``."""
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()

    def _loop(self) -> None:
        while not self._stop.is_set():
            self.run_cycle()
            self._wake.wait(self.every)
            self._wake.clear()

    def request_now(self) -> None:
        self._wake.set()

    def pause(self) -> None:
        self._go.clear()
        if not self._busy.locked():
            self.phase = "Paused"

    def resume(self) -> None:
        self.phase = "Idle" if self.phase == "Paused" else self.phase
        self._go.set()

    def stop(self) -> None:
        self._stop.set()
        self._wake.set()
        if self._thread:
            self._thread.join()


def embed_missing(chunks: DataFrame, embeddings: DataFrame, model: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """STR10: (embeddings, failed): chunks without a vector go through ``model`` until none is left or a round gets no further; what has none then is told, not asked for for ever."""
    for _ in range(rounds):
        left = C.missing_embeddings(chunks, embeddings)
        if left.isEmpty():
            break
        made = model(left)
        embeddings = embeddings.unionByName(made.select(*embeddings.columns))
    return embeddings, C.missing_embeddings(chunks, embeddings)


def embedding_pages(embeddings: DataFrame, key: str = "vec_id", rows: int = 500):
    """SRC17: all vectors in order of their key, in pages of up to ``rows`` on the driver, one partition's at a time."""
    page: list = []
    for row in embeddings.orderBy(key).toLocalIterator():
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page


def register_functions(spark) -> None:
    """§2.12: functions for SQL: fts_tokenize (and fts_terms), fts_stem, family_key, snippet, cosine_sim, html_text, split_bigrams, html_unescape; and the table function chunk_text."""
    import html


    from ..functions.stem import porter1

    def plain(kind, returns):
        return F.pandas_udf(returns)(kind)

    def stem(words_: pd.Series) -> pd.Series:
        return words_.map(porter1, na_action="ignore")

    def bigrams(texts: pd.Series) -> pd.Series:
        return texts.map(X.split_bigrams, na_action="ignore")

    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            if x is None or y is None or len(x) != len(y):
                return 0.0
            x, y = np.asarray(x, float), np.asarray(y, float)
            n = np.sqrt((x @ x) * (y @ y))
            return float(x @ y / n) if n > 0 else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    for name in ("fts_tokenize", "fts_terms"):
        spark.udf.register(name, X.porter_terms_udf)
    spark.udf.register("fts_stem", plain(stem, "string"))
    spark.udf.register("split_bigrams", plain(bigrams, "string"))
    spark.udf.register("html_unescape", plain(unescape, "string"))
    spark.udf.register("cosine_sim", plain(cosine, "double"))
    # SQL functions of expressions stay in the JVM.
    steps = "name"
    for pattern, new in words.FAMILY_STEPS:
        steps = f"regexp_replace({steps}, {_sql(pattern)}, {_sql(new)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION family_key(folder STRING, name STRING) RETURNS STRING RETURN lower(concat(coalesce(folder, ''), '|', trim({steps})))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION html_text(markup STRING) RETURNS STRING RETURN trim(regexp_replace(html_unescape(regexp_replace(regexp_replace(markup, '(?is)<(script|style)[^>]*>.*?</\\\\1>', ' '), '(?s)<[^>]+>', ' ')), '\\\\s+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION snippet(content STRING, term STRING) RETURNS STRING RETURN CASE WHEN locate(lower(term), lower(content)) > 0 THEN concat(CASE WHEN locate(lower(term), lower(content)) > 101 THEN '...' ELSE '' END, substring(content, greatest(1, locate(lower(term), lower(content)) - 100), least(200, least(locate(lower(term), lower(content)) - 1, 100) + length(term) + 100)), CASE WHEN greatest(0, locate(lower(term), lower(content)) - 101) + least(200, least(locate(lower(term), lower(content)) - 1, 100) + length(term) + 100) < length(content) THEN '...' ELSE '' END) WHEN length(content) <= 200 THEN content ELSE concat(substring(content, 1, 200), '...') END")

    @F.udtf(returnType="chunk_index: int, text: string, start_offset: bigint")
    class ChunkText:
        def eval(self, text: str):
            for i, (start, piece) in enumerate(K.chunk_text(text)):
                yield i, piece, start

    spark.udtf.register("chunk_text", ChunkText)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
