"""Registered queries of the engine's calls, jobs, mutations and stored state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import wordpieces as W
from ..functions.query import Any
from ..operators import feedback as B
from ..operators import index as I
from ..operators import logs as L
from ..operators import mutations as M
from ..operators import results as R
from ..operators import search as S
from ..sources import corpus as T
from ..sources import scan, store
from ..sources.corpus import AS_OF, CHUNKS_SQL, CLICKS_SQL, FILES_SQL
from ..streaming import jobs, processors
from . import api
from .catalogue import BEST_SQL, EMBEDDED_SQL, HITS_SQL, OR_TERMS, SIMPLE, TOP_SQL, _embedded, _hits, bm25_ctes, index, now, register
from .language import Atom, stemmed_ctes


def engine(spark, sf_dir, tokenizer: str = "porter") -> api.Engine:
    own = index(spark, sf_dir, tokenizer)
    return api.Engine(T.files(spark, sf_dir), own.chunks, now(), tokenizer=tokenizer, index=own)


# -- calls -----------------------------------------------------------------------


@register(
    """SELECT b.file_id AS "fileId", f.filename, b.path, f.extension, round_even(b.score, 4) AS score, array_to_string(list_filter([CASE WHEN b.match_source & 1 <> 0 THEN 'FileName' END, CASE WHEN b.match_source & 2 <> 0 THEN 'Content' END, CASE WHEN b.match_source & 4 <> 0 THEN 'Folder' END], lambda x: x IS NOT NULL), ', ') AS "matchSource", strftime(f.modified_at, '%Y-%m-%d %H:%M:%S') AS "modifiedAt" FROM (SELECT * FROM best WHERE n = 1 ORDER BY score DESC, file_id LIMIT 20) b JOIN files f USING (file_id)""",
    FILES_SQL,
    CHUNKS_SQL,
    stemmed_ctes([Atom("erin", True), Atom("pour", True)], "{h0} OR {h1}"),
    BEST_SQL,
)
def api_search_files(spark, sf_dir):
    """API1, API5, SNK15, FLT18, FN32, FTS15: the call's items; asked twice, the second answer is the first's."""
    e = engine(spark, sf_dir)
    got = e.search_files("the erin pour", 20)
    if e.search_files("the erin pour", 20) is not got:
        raise AssertionError("a search within the cache's time must give the kept answer")
    keys = ["fileId", "filename", "path", "extension", "score", "matchSource", "modifiedAt"]
    return spark.createDataFrame([tuple(i[k] for k in keys) for i in got["items"]], '`fileId` string, filename string, path string, extension string, score double, `matchSource` string, `modifiedAt` string')


@register("SELECT count(*) > 0 AS scan_complete, count(*) AS total_files, (SELECT count(*) FROM files WHERE extract_status = 'SUCCESS' AND extension IN ('.txt', '.md', '.docx', '.pdf', '.xlsx', '.html', '.json', '.log')) AS indexed_files, (SELECT count(*) FROM chunks) AS total_chunks, 0 AS embedded_chunks, false AS embedding_complete, strftime(max(modified_at), '%Y-%m-%d %H:%M:%S') AS last_scan FROM files", FILES_SQL, CHUNKS_SQL)
def api_status(spark, sf_dir):
    """API4, SNK11, STR8: the status call's fields, read back from the stamp it was written to."""
    e = engine(spark, sf_dir, "simple")
    s = e.get_pipeline_status()
    row = e.stamp(f"{store.shared_dir(spark)}/lumenspan-stamps/{store.stamp(spark, f'{sf_dir}/documents.parquet')}", "Complete").where("phase = 'Complete'").first()
    if (row["files"], row["indexed"], row["chunks"]) != (s["totalFiles"], s["indexedFiles"], s["totalChunks"]):
        raise AssertionError("the stamp and the status call must tell the same")
    return spark.createDataFrame([(s["scanComplete"], s["totalFiles"], s["indexedFiles"], s["totalChunks"], s["embeddedChunks"], s["embeddingComplete"], s["lastScanAt"])], "scan_complete boolean, total_files long, indexed_files long, total_chunks long, embedded_chunks int, embedding_complete boolean, last_scan string")


@register("SELECT file_id, path, true AS there FROM files WHERE doc_id IN (1, 2, 3, 5, 8) UNION ALL SELECT NULL, '/none', false", FILES_SQL)
def file_lookups(spark, sf_dir):
    """FLT16: files by path, case aside, and by id."""
    f = T.files(spark, sf_dir)
    e = api.Engine(f, None, now())
    rows = []
    for r in f.where("doc_id in (1, 2, 3, 5, 8)").select("path").collect():  # the asked ones
        found = e.find(path=r["path"].upper())
        rows.append((found["file_id"], e.find(file_id=found["file_id"])["path"], e.exists(r["path"].swapcase())))
    return spark.createDataFrame([*rows, (None, "/none", e.exists("/none"))], "file_id string, path string, there boolean")


@register("SELECT * FROM clicks", FILES_SQL, """bounced AS (SELECT event_id, doc_id, ts, query, position, coalesce(nt = 'view' AND nms - ms <= 1800000 AND NOT (starts_with(query, nq) OR starts_with(nq, query)), false) AS is_bounce
  FROM (SELECT *, lead(event_type) OVER w AS nt, lead(ms) OVER w AS nms, lead(query) OVER w AS nq FROM (SELECT *, epoch_ms(ts) AS ms FROM click_log) WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) WHERE event_type = 'click'),
clicks AS (SELECT b.query, lower(f.path) AS path_key, count(*) AS click_count, min(position) AS position, bool_or(is_bounce) AS is_bounce FROM bounced b JOIN files f USING (doc_id) GROUP BY 1, 2)""".replace("bounced AS", CLICKS_SQL + ",\nbounced AS", 1))
def api_clicks(spark, sf_dir):
    """API9, SNK10, STR4: clicks and searches of all sessions, as a stream of the log judges them."""
    log = T.click_log(spark, sf_dir)
    judged = _streamed(log.select("event_id", "ts", "user_id", "event_type", "query"), "api-clicks", lambda s: processors.bounces(s, 1800.0, "40 days"))
    met = log.drop("user_id", "query").join(judged, "event_id").join(T.files(spark, sf_dir).select("doc_id", "path"), "doc_id")
    return B.click_table(met).select("query", "path_key", "click_count", "position", "is_bounce")


@register("SELECT count(*) FILTER (event_id % 4 = 0) AS searches, count(*) FILTER (event_id % 4 = 0 AND event_id % 13 = 0) AS empty, count(*) FILTER (event_id % 4 = 0 AND event_id % 3 = 0) AS fast, count(*) FILTER (event_id % 4 = 0 AND event_id % 3 = 1) AS smart FROM events")
def api_telemetry(spark, sf_dir):
    """API9, AGG19, AGG20: counters of all searches less those that were sent before the last ones came in."""
    e = T.table(spark, sf_dir, "events")
    mode = F.get(F.array(F.lit("Fast"), F.lit("Smart"), F.lit("Deep")), (F.col("event_id") % 3).cast("int"))
    s = e.select("event_id", mode.alias("mode"), (F.col("event_id") % 500).alias("duration_ms"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(5).alias("results"))
    all_, sent = (B.telemetry(x, F.lit(0)) for x in (s, s.where("event_id % 4 <> 0")))
    return B.subtract(all_, sent, ["searches", "empty", "fast", "smart"])


@register("SELECT greatest(0, a - b) AS searches, greatest(0, c - d) AS clicks FROM (SELECT count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'view' AND event_id % 3 = 0) AS b, count(*) FILTER (event_type = 'click' AND event_id % 3 = 0) AS c, count(*) FILTER (event_type = 'click') AS d FROM events)")
def counters_sent(spark, sf_dir):
    """AGG20 on tables."""
    e = T.table(spark, sf_dir, "events")
    view, click, third = F.col("event_type") == "view", F.col("event_type") == "click", F.col("event_id") % 3 == 0
    return B.subtract(e.agg(F.count_if(view).alias("searches"), F.count_if(click & third).alias("clicks")), e.agg(F.count_if(view & third).alias("searches"), F.count_if(click).alias("clicks")), ["searches", "clicks"])


# -- streams --------------------------------------------------------------------------


@register("SELECT query, lower(f.path) AS path_key, count(*) AS click_count, max(ts) AS last_clicked, min(position) AS position FROM click_log c JOIN files f USING (doc_id) WHERE event_type = 'click' GROUP BY 1, 2", FILES_SQL, CLICKS_SQL)
def stream_clicks(spark, sf_dir):
    """STR5, SNK10: running click counts of a streaming job, upserted and compacted, under the batch table's keys."""
    out = f"{store.shared_dir(spark)}/lumenspan-clicks/{store.stamp(spark, f'{sf_dir}/events.parquet')}"
    keys = ["query", "path_key"]
    source = f"{out}/events"
    if not store.exists(spark, f"{source}/_SUCCESS"):
        log = T.click_log(spark, sf_dir).where("event_type = 'click'").join(T.files(spark, sf_dir).select("doc_id", "path"), "doc_id")
        log.select(F.concat(F.lit("the "), "query").alias("query"), "path", "ts", "position").repartition(6).write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema("query string, path string, ts timestamp_ntz, position int").option("maxFilesPerTrigger", 2).parquet(source)
    jobs.click_counts(stream).writeStream.outputMode("update").foreachBatch(jobs.upsert_sink(f"{out}/clicks", keys, 2)).option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start().awaitTermination()
    return jobs.latest(spark, f"{out}/clicks", keys)


@register("SELECT user_id, arg_max(event_type, (ts, event_id)) AS query, count(*) AS keystrokes FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def typing_sessions(spark, sf_dir):
    """STR6 in batch, with pauses of six hours: the test events are hours apart."""
    e = T.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("query"))
    return jobs.typing_sessions(e, "6 hours").select("user_id", "query", "keystrokes")


@register(
    """SELECT event_id, event_type FROM r WHERE shown""",
    "RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)",
    "r AS (SELECT user_id, n, event_id, ts, event_type, ts AS fired, true AS shown FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, e.ts, e.event_type, CASE WHEN e.event_type <> r.event_type OR e.ts - r.fired >= INTERVAL 6 HOUR THEN e.ts ELSE r.fired END, e.event_type <> r.event_type OR e.ts - r.fired >= INTERVAL 6 HOUR FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)",
)
def progress_throttle(spark, sf_dir):
    """STR7: reports that are passed on, six hours apart or at a change of phase."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return jobs.throttle(e, "user_id", "event_type", ["ts", "event_id"], 6 * 3600).select("event_id", "event_type")


PAUSED_SQL = "nexts AS (SELECT *, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) - epoch_ms(ts) AS pause FROM events)"
HOUR = 3600.0


def _events(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


def _streamed(events, name: str, job):
    """What a stream of all ``events``, in six files of no order, makes of them; a last event of another user ends all waiting."""
    spark = events.sparkSession
    at = f"{store.shared_dir(spark)}/lumenspan-{name}/{uuid.uuid4().hex}"
    fs, where = store.filesystem(spark, at)
    fs.deleteOnExit(where)
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    end = e.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(*[F.col(c) if c == "ts" else F.lit(-1).cast(t).alias(c) if t != "string" else F.lit("end").alias(c) for c, t in e.dtypes])
    e.repartition(6).write.parquet(f"{at}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/*")
    run = lambda: job(stream).writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-mark").trigger(availableNow=True).start().awaitTermination()
    run()
    end.write.parquet(f"{at}/ending")
    run()  # goes on from the checkpoint
    return spark.read.parquet(f"{at}-out").where("event_id >= 0")


@register("SELECT event_id, event_type AS query FROM nexts WHERE pause IS NULL OR pause >= 6 * 3600000", PAUSED_SQL)
def stream_debounce(spark, sf_dir):
    """STR6: a stream where a newer text cancels an older one, with pauses of six hours: the test events are hours apart."""
    return _streamed(_events(spark, sf_dir), "debounce", lambda s: processors.debounced(s, text="event_type", gap=6 * HOUR, late="40 days")).select("event_id", F.col("text").alias("query"))


@register(
    "SELECT event_id, event_type FROM r WHERE shown",
    "RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events)",
    """r AS (SELECT user_id, n, event_id, ms, event_type, ms AS fired, true AS shown FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.n, e.event_id, e.ms, e.event_type, CASE WHEN e.event_type <> r.event_type OR e.ms - r.fired >= 6 * 3600000 THEN e.ms ELSE r.fired END, e.event_type <> r.event_type OR e.ms - r.fired >= 6 * 3600000
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)""",
)
def stream_throttle(spark, sf_dir):
    """STR7: a stream of reports that are passed on at a change of phase, else six hours apart."""
    return _streamed(_events(spark, sf_dir), "throttle", lambda s: processors.throttled(s, phase="event_type", every=6 * HOUR, late="40 days")).select("event_id", F.col("text").alias("event_type"))


@register(
    "SELECT event_id, coalesce(nt = 'view' AND nms - ms <= 1800000 AND NOT (starts_with(event_type, nt) OR starts_with(nt, event_type)), false) AS is_bounce FROM (SELECT *, lead(event_type) OVER w AS nt, lead(ms) OVER w AS nms FROM (SELECT *, epoch_ms(ts) AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) WHERE event_type = 'click'"
)
def stream_bounces(spark, sf_dir):
    """STR4: a stream of clicks and searches, half an hour instead of ten seconds."""
    return _streamed(_events(spark, sf_dir), "bounces", lambda s: processors.bounces(s.withColumn("query", F.col("event_type")), 1800.0, "40 days")).select("event_id", "is_bounce")


# -- mutations and stored state ---------------------------------------------------------


@register("SELECT file_id, path, CASE WHEN doc_id % 3 = 0 THEN size_bytes * 2 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 3 = 0 THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at FROM files", FILES_SQL)
def update_by_path(spark, sf_dir):
    """SNK7: sizes and times by path, case aside."""
    f = T.files(spark, sf_dir)
    new = f.where("doc_id % 3 = 0").select(F.upper("path").alias("path"), (F.col("size_bytes") * 2).alias("size_bytes"), (F.col("modified_at") + F.expr("interval 1 day")).alias("modified_at"))
    return M.update_by_path(f, new).select("file_id", "path", "size_bytes", "modified_at")


@register("SELECT vec_id, 'm' AS model_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 'm', label FROM embeddings WHERE vec_id % 50 = 0")
def upsert_embeddings(spark, sf_dir):
    """SNK8: vectors put in by key, twice with the same outcome."""
    e = T.embeddings(spark, sf_dir).select("vec_id", F.lit("m").alias("model_id"), "label")
    changed = e.where("vec_id % 4 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    once = M.upsert(e, changed, ["vec_id", "model_id"])
    return M.upsert(once, changed, ["vec_id", "model_id"])


@register("SELECT file_id, CASE WHEN doc_id % 4 = 0 THEN 'fresh' ELSE text END AS text FROM (SELECT c.file_id, doc_id, c.chunk_index, c.text FROM chunks c JOIN files USING (file_id)) WHERE doc_id % 4 <> 0 OR chunk_index = 0", FILES_SQL, CHUNKS_SQL)
def replace_chunks(spark, sf_dir):
    """SNK3, AGG21: the files of a batch of chunks lose all their old ones."""
    c = T.chunks(spark, sf_dir).select("file_id", "chunk_index", "text")
    fresh = T.files(spark, sf_dir).where("doc_id % 4 = 0").join(c.where("chunk_index = 0").select("file_id"), "file_id", "left_semi").select("file_id", F.lit(0).alias("chunk_index"), F.lit("fresh").alias("text"))
    return M.replace_chunks(c, fresh).select("file_id", "text")


@register("SELECT count(*) AS n, count(DISTINCT page) AS pages, CAST(sum(vec_id) AS BIGINT) AS total FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 500 AS page FROM embeddings)")
def embedding_pages(spark, sf_dir):
    """SRC17: all vectors, page by page."""
    seen, pages, total = 0, 0, 0
    for page in api.embedding_pages(T.embeddings(spark, sf_dir).select("vec_id")):
        seen, pages, total = seen + len(page), pages + 1, total + sum(r["vec_id"] for r in page)
    return spark.createDataFrame([(seen, pages, total)], "n long, pages long, total long")


@register("SELECT c.file_id, c.chunk_index, c.vector FROM (SELECT file_id, chunk_index, length(text) % 7 + 1 AS vector FROM chunks WHERE length(text) > 0 AND length(text) % 5 <> 0) c ANTI JOIN embedded USING (file_id, chunk_index)", FILES_SQL, CHUNKS_SQL, EMBEDDED_SQL)
def embed_missing(spark, sf_dir):
    """STR10, JN4: vectors made for chunks without; those that the model never manages end the loop instead of keeping it going."""
    c, have = T.chunks(spark, sf_dir), _embedded(spark, sf_dir).select("file_id", "chunk_index", F.lit(0).alias("vector"))
    model = lambda left: left.where(F.length("text") % 5 != 0).select("file_id", "chunk_index", (F.length("text") % 7 + 1).cast("int").alias("vector"))
    made, _ = api.embed_missing(c, have, model, 2)
    return made.where("vector > 0")


@register("SELECT count(*) AS postings, count(DISTINCT t) AS terms, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT chunk_id, t, count(*) AS n FROM (SELECT chunk_id, unnest(list_concat(a, list_concat(b, c))) AS t FROM split_) GROUP BY 1, 2)", FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("x")], "true"))
def index_rebuild(spark, sf_dir):
    """SNK12: an index of an older version is built anew, and its postings hold every occurrence of every term."""
    at = f"{store.shared_dir(spark)}/lumenspan-rebuild/{uuid.uuid4().hex}"
    fs, where = store.filesystem(spark, at)
    fs.deleteOnExit(where)
    spark.range(1).write.mode("overwrite").parquet(f"{at}/version=0-simple/corpus")
    own = I.ensure(spark, at, lambda: T.chunks(spark, sf_dir), "simple")
    if "version=0-simple" in store.names(spark, at):
        raise AssertionError("the older index must go")
    found = own.postings(own.blocks("", True))
    return found.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum(F.col("n_text") + F.col("n_filename") + F.col("n_folder_path")).alias("occurrences"))


UPDATED_FILES_SQL = "files AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 4 THEN 'erin new ' || text ELSE text END AS text) FROM files_ WHERE doc_id % 10 <> 5)"


@register(TOP_SQL, FILES_SQL.replace("files AS", "files_ AS", 1), UPDATED_FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"))
def index_updates(spark, sf_dir):
    """SNK2-SNK5, SNK13, SNK12, TOP1: the best chunks after three commits on an index: files come in, a tenth is rewritten, a tenth goes; the search equals one on a new index."""
    at = f"{store.shared_dir(spark)}/lumenspan-updates/{uuid.uuid4().hex}"
    fs, where = store.filesystem(spark, at)
    fs.deleteOnExit(where)
    kind, files = F.col("doc_id") % 10, T.files(spark, sf_dir, True)
    own = I.Index(spark, at, "simple")
    own.update(T.chunked(files.where(kind >= 3)))
    own.update(T.chunked(files.where(kind < 3)))
    changed = files.where(kind == 4).withColumn("text", F.concat(F.lit("erin new "), F.col("text")))
    own.update(T.chunked(changed), files.where(kind.isin(4, 5)))
    best = own.top(OR_TERMS, S.most_candidates(SIMPLE), 6)
    return best.select("file_id", "chunk_id", "bm25", "match_source")


@register("SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(list_concat(a, list_concat(b, c))) AS term FROM split_) GROUP BY term", FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("x")], "true"))
def term_dictionary(spark, sf_dir):
    """FTS3, AGG24: every term with its document frequency, from block counts alone."""
    return index(spark, sf_dir).dictionary().select("term", F.col("df").cast("long").alias("df"))


MAILS_SQL = """chunks AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS file_id, CAST(conv_id * 100 + turn AS VARCHAR) AS chunk_id, 0 AS chunk_index,
  CASE WHEN turn % 3 = 1 THEN 'changed' ELSE role END AS filename, coalesce(text, '') AS text, '' AS folder_path FROM conversations WHERE turn % 3 <> 2)"""


@register(TOP_SQL, MAILS_SQL, bm25_ctes([Atom("changed"), Atom("the")], "{h0} OR {h1}"))
def mail_search(spark, sf_dir):
    """SNK13: a search over mails (subject and body) after inserts, updates and deletes."""
    at = f"{store.shared_dir(spark)}/lumenspan-mails/{uuid.uuid4().hex}"
    fs, where = store.filesystem(spark, at)
    fs.deleteOnExit(where)
    id_ = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    mails = T.table(spark, sf_dir, "conversations").select("turn", id_.alias("file_id"), id_.alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("role").alias("filename"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("folder_path"))
    own = I.Index(spark, at, "simple")
    own.update(mails.drop("turn"))
    own.update(mails.where("turn % 3 = 1").withColumn("filename", F.lit("changed")).drop("turn"), mails.where("turn % 3 > 0"))
    best = own.top(Any((Atom("changed"), Atom("the"))), S.most_candidates(SIMPLE), 6)
    return best.select("file_id", "chunk_id", "bm25", "match_source")


@register("SELECT conv_id * 100 + turn AS id, array_to_string(regexp_extract_all(lower(CASE WHEN turn % 3 = 1 THEN 'changed ' || coalesce(text, '') ELSE role || ' ' || coalesce(text, '') END), '[\\p{L}\\p{N}]+'), ' ') AS terms FROM conversations WHERE turn % 3 <> 2")
def mail_index(spark, sf_dir):
    """SNK13: an index of mails after inserts, updates and deletes."""
    c = T.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    start = I.synced(spark.createDataFrame([], "id long, terms array<string>"), c.select("id", F.lit("insert").alias("op"), F.col("role").alias("subject"), F.col("text").alias("body")))
    op = F.when(F.col("turn") % 3 == 1, "update").otherwise("DELETE")
    changes = c.where("turn % 3 <> 0").select("id", op.alias("op"), F.lit("changed").alias("subject"), F.col("text").alias("body"))
    return I.synced(start, changes).select("id", F.array_join("terms", " ").alias("terms"))


@register("SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vector_blobs(spark, sf_dir):
    """FN28: vectors to bytes and back."""
    b = T.embeddings(spark, sf_dir).withColumn("blob", W.to_blob(F.col("embedding")))
    total = F.aggregate(F.transform("back", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return b.withColumn("back", W.from_blob(F.col("blob"))).select("vec_id", F.octet_length("blob").alias("bytes"), F.round(total, 6).alias("total"))


#: A small vocabulary: special pieces, syllables of the test texts, and their continuations.
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"the of and in to on er th an re".split(), *(f"##{p}" for p in "the of and in to on er th an re tion st".split())]


def _vocabulary_sql() -> str:
    """Greedy pieces of each distinct word, one after the other, in SQL."""
    heads = " ".join(f"WHEN pos = 0 AND starts_with(w, '{p}') THEN {len(p)}" for p in sorted((p for p in PIECES[4:] if not p.startswith("##")), key=len, reverse=True))
    tails = " ".join(f"WHEN pos > 0 AND starts_with(substr(w, pos + 1), '{p[2:]}') THEN {len(p) - 2}" for p in sorted((p for p in PIECES if p.startswith("##")), key=len, reverse=True))
    ids = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PIECES))
    return f"""RECURSIVE words_ AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\p{{P}}]+'), lambda x: x <> '')) AS w FROM documents),
uses AS (SELECT doc_id, w, count(*) AS n FROM words_ GROUP BY 1, 2),
walk AS (SELECT w, 0 AS pos, 0 AS piece, 0 AS ids, 0 AS total FROM (SELECT DISTINCT w FROM uses) UNION ALL
  SELECT w, pos + wide, wide, ids + 1, total + CASE CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(w, pos + 1, wide) {ids} ELSE 1 END FROM (SELECT *, CASE {heads} {tails} ELSE 1 END AS wide FROM walk WHERE pos < length(w))),
ends_ AS (SELECT w, ids, total FROM walk WHERE pos = length(w))"""


@register("SELECT d.doc_id, CAST(2 + coalesce(sum(n * ids), 0) AS BIGINT) AS n_ids, CAST(5 + coalesce(sum(n * total), 0) AS BIGINT) AS sum_ids FROM documents d LEFT JOIN uses USING (doc_id) LEFT JOIN ends_ USING (w) GROUP BY d.doc_id", _vocabulary_sql())
def word_piece_ids(spark, sf_dir):
    """SRC18, FN27, FN37: whole texts as word pieces between start and end, by a vocabulary read from a file."""
    path = f"{store.shared_dir(spark)}/lumenspan-vocabulary"
    spark.createDataFrame([(i, p) for i, p in enumerate(PIECES)], "id long, piece string").write.mode("overwrite").parquet(path)
    vocabulary = {r["piece"]: r["id"] for r in spark.read.parquet(path).collect()}
    ids = W.encode(F.col("text"), vocabulary, 1 << 30)
    return T.table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ids"))


@register("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN folder_path || '|/b' WHEN 1 THEN '/s' ELSE '/home/' || doc_id END AS roots FROM files", FILES_SQL)
def scan_roots(spark, sf_dir):
    """SRC2: folders asked for, else those of the settings, else the home folder, for a call of each document."""

    @F.pandas_udf("string")
    def roots(asked, settings, home):
        return (asked + "\n" + settings + "\n" + home).map(lambda x: "|".join(scan.scan_roots(x.split("\n")[0].split("|") if x.split("\n")[0] else None, {"scan_roots": x.split("\n")[1].split("|")} if x.split("\n")[1] else None, x.split("\n")[2])))

    kind = F.col("doc_id") % 3
    asked, settings = F.when(kind == 0, F.concat("folder_path", F.lit("|/b"))).otherwise(""), F.when(kind != 2, "/s").otherwise("")
    return T.files(spark, sf_dir).select("doc_id", roots(asked, settings, F.concat(F.lit("/home/"), F.col("doc_id").cast("string"))).alias("roots"))


@register("SELECT doc_id, 'x' || chr(9) || 'CAT' || chr(9) || 'path=\"' || path || ' copy\"' || chr(9) || 'n=' || size_bytes AS line, path || ' copy' AS back FROM files", FILES_SQL)
def log_lines(spark, sf_dir):
    """SNK16, FN38: log lines as they are written, and read back."""
    f = T.files(spark, sf_dir).withColumn("shown", F.concat("path", F.lit(" copy")))
    line = L.log_line(F.lit("x"), F.lit(None).cast("string"), F.lit("CAT"), {"path": F.col("shown"), "n": F.col("size_bytes")})
    return f.select("doc_id", line.alias("line")).withColumn("back", F.regexp_extract("line", 'path="([^"]*)"', 1))


@register("SELECT count(*) + 4 AS lines, '| ' || min(ext) || ' | ' || arg_min(n, ext) || ' |' AS first FROM (SELECT extension AS ext, count(*) AS n FROM files GROUP BY 1)", FILES_SQL)
def markdown_report(spark, sf_dir):
    """SNK17, API10: a result as a Markdown table."""
    n = T.files(spark, sf_dir).groupBy(F.col("extension").alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")
    lines = L.markdown({"Files": n}).split("\n")
    return spark.createDataFrame([(sum(x != "" for x in lines) + 1, lines[4])], "lines long, first string")


# -- badges ------------------------------------------------------------------------------

FAMILY = "'/x|doc' || CASE WHEN regexp_full_match(n, '\\d{1,2}|[012]\\d(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])|20\\d{6}') THEN '' ELSE ' ' || n END || folder_path"
AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified_at)) / 86400e6"
BADGES_SQL = f"""facts AS (SELECT h.*, regexp_extract(filename, 'doc_(\\d+)_v', 1) AS n, CASE WHEN doc_id % 5 = 0 THEN CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified_at + INTERVAL 150 DAY)) / 86400e6) AS BIGINT) END AS ago, CASE WHEN doc_id % 5 = 0 THEN doc_id % 9 END AS clicks,
  CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 END AS match_count, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS first_match, {AGE} AS age, count(*) OVER (PARTITION BY lower(folder_path)) AS in_folder FROM hits h),
kin AS (SELECT *, count(*) OVER (PARTITION BY {FAMILY}) AS versions, row_number() OVER (PARTITION BY {FAMILY} ORDER BY score DESC, file_id) AS position FROM facts),
pairs AS (SELECT *, max(CAST(extension = '.pdf' AS INT)) OVER w AS p, max(CAST(extension IN ('.docx', '.doc', '.ppt', '.pptx') AS INT)) OVER w AS o FROM kin WINDOW w AS (PARTITION BY lower(folder_path), lower(regexp_replace(filename, '\\.[^./]*$', '')))),
noted AS (SELECT file_id, list_filter([
  CASE WHEN p = 1 AND o = 1 AND extension = '.pdf' THEN '1:final_pdf' END, CASE WHEN p = 1 AND o = 1 AND extension IN ('.docx', '.doc', '.ppt', '.pptx') THEN '1:has_pdf' END,
  CASE WHEN versions > 1 AND position = 1 THEN '2:latest:' || versions END, CASE WHEN versions > 1 AND position > 1 THEN '2:not_latest' END,
  CASE WHEN clicks >= 5 THEN '3:often_opened:' || clicks END,
  CASE WHEN ago < 1 THEN '4:opened_today' WHEN ago < 7 THEN '4:opened_days_ago:' || ago WHEN ago < 14 THEN '4:opened_last_week' WHEN ago < 60 THEN '4:opened_last_month' END,
  CASE WHEN first_match = 0 THEN '5:in_title' END, CASE WHEN first_match IN (1, 2) THEN '5:on_first_page' END, CASE WHEN match_count >= 2 THEN '6:in_places:' || match_count END,
  CASE WHEN age < 1 THEN '7:modified_today' END, CASE WHEN age >= 1 AND age < 7 THEN '7:modified_this_week' END, CASE WHEN in_folder >= 3 THEN '8:related_in_folder:' || in_folder END,
  CASE WHEN age >= 7 AND age < 30 THEN '9:modified_this_month' END, CASE WHEN age > 730 THEN '10:old' END, CASE WHEN versions > 1 AND position > 1 THEN '11:nth_version:' || position END], lambda x: x IS NOT NULL) AS notes FROM pairs)"""


@register("SELECT file_id, array_to_string(notes[1:3], ';') AS notes FROM noted", FILES_SQL, HITS_SQL, BADGES_SQL)
def badges(spark, sf_dir):
    """§2.10, JN14, AGG10, TOP9"""
    h = _hits(spark, sf_dir)
    opened = h.where("doc_id % 5 = 0").select(X.click_path(F.col("path")).alias("path_key"), (F.col("modified_at") + F.expr("interval 150 days")).alias("last_opened"), (F.col("doc_id") % 9).alias("clicks"))
    matched = h.where("doc_id % 2 = 0").select("file_id", (F.col("doc_id") % 4).alias("match_count"), (F.col("doc_id") % 5).cast("int").alias("first_match"))
    out = R.badges(h, now(), opened, R.family_positions(h), matched)
    return out.select("file_id", F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["priority"].cast("string"), n["code"], n["n"].cast("string"))), ";").alias("notes"))
