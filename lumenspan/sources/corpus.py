"""Base tables: files, chunks, embeddings, clicks, searches and log lines, derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunks import MOST, chunk_files

#: The day that recency and ages are counted from, instead of a clock.
AS_OF = "2024-07-01 00:00:00"
EXTENSIONS = [".txt", ".md", ".docx", ".pdf", ".xlsx", ".html", ".json", ".log"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """One file per document: path, name, extension, folder, times, size, status and error code from doc_id alone."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (d % len(EXTENSIONS)).cast("int"))
    name = F.concat(F.lit("doc_"), F.expr("doc_id div 2").cast("string"), F.when(d % 2 == 0, "_v1").otherwise("_v2"), ext)
    folder = F.concat(F.lit("/corpus/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.coalesce("source", F.lit("none")))
    status = F.when(d % 17 == 0, "ERROR").when(d % 23 == 0, "SKIPPED").when(d % 11 == 0, "PENDING").otherwise("SUCCESS")
    code = F.when(d % 17 == 0, F.get(F.array(F.lit("TOO_LARGE"), F.lit("ENCRYPTED"), F.lit("PARSE_ERROR")), (d % 3).cast("int")))
    out = docs.select(
        d,
        ext.alias("extension"),
        name.alias("filename"),
        folder.alias("folder_path"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))").alias("modified_at"),
        F.col("n_chars").alias("size_bytes"),
        status.alias("extract_status"),
        code.alias("error_code"),
        *(["text"] if with_text else []),
    )
    out = out.withColumn("path", F.concat_ws("/", "folder_path", "filename"))
    return out.withColumn("file_id", X.file_id(F.col("path")))


def chunks(spark: SparkSession, sf_dir: str, most: int | None = MOST) -> DataFrame:
    """file_id, chunk_index, chunk_id, text, start_offset, end_offset, content_hash, with filename and folder for the index; of each file the first ``most``, None: all."""
    return chunked(files(spark, sf_dir, True), most)


def chunked(found: DataFrame, most: int | None = MOST) -> DataFrame:
    """The chunks of files with their texts."""
    found = chunk_files(found.select("file_id", "filename", "folder_path", "text"), most=most)
    return found.withColumn("chunk_id", X.chunk_id(F.col("file_id"), F.col("chunk_index"))).withColumn("content_hash", X.content_hash(F.col("text")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the first chunks of files: vec_id stands for doc_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding", "label")


def _event_path(files_count: int):
    return F.col("event_id") % files_count


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per click: user_id, ts, query, doc_id of the file, position; searches are the log's view events."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_files"))
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).crossJoin(F.broadcast(n))  # one row
    query = F.concat(F.lit("q"), (F.floor(F.coalesce("value", F.lit(0.0))) % 20).cast("long").cast("string"))
    return ev.select("event_id", "user_id", "ts", "event_type", query.alias("query"), (F.col("event_id") % F.col("n_files")).alias("doc_id"), (F.col("event_id") % 10).cast("int").alias("position"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic lines as text, one per file: tab-separated time, elapsed, category and k=v pairs; some comments and broken lines."""
    d, f = F.col("doc_id"), files(spark, sf_dir)
    stamp = F.concat(F.date_format(F.col("modified_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    result = F.when(d % 17 == 0, "error:PARSE_ERROR").when(d % 23 == 0, "skip_cloud").otherwise("ok")
    ms = (F.col("size_bytes") % 997).cast("string")
    kv = F.concat(F.lit('path="'), F.col("path"), F.lit('"\text='), F.col("extension"), F.lit("\tsize_bytes="), F.col("size_bytes").cast("string"), F.lit("\textract_ms="), ms, F.lit("\tchunks="), F.expr("size_bytes div 1000 + 1").cast("string"), F.lit("\tresult="), result)
    detail = F.concat(F.lit("ext="), F.col("extension"), F.lit("\tstage="), F.when(d % 3 == 0, "open").when(d % 3 == 1, "parse").otherwise("join"), F.lit("\ttime_ms="), (F.col("size_bytes") % 331).cast("string"))
    extract = F.concat(stamp, F.lit("\t00:00:00.000\tEXTRACT_FILE\t"), kv)
    parse = F.concat(stamp, F.lit("\t00:00:00.000\tPARSE_DETAIL\t"), detail)
    odd = F.when(d % 50 == 0, F.array(F.lit("# comment"), F.lit("broken line"))).otherwise(F.array().cast("array<string>"))
    return f.select(F.explode(F.concat(F.array(extract, parse), odd)).alias("value"))


# -- the same derivations for DuckDB -------------------------------------------

FILES_SQL = """files AS (
  SELECT *, substr(sha256(lower(path)), 1, 16) AS file_id FROM (
    SELECT *, folder_path || '/' || filename AS path FROM (
      SELECT doc_id, text, (['.txt','.md','.docx','.pdf','.xlsx','.html','.json','.log'])[doc_id % 8 + 1] AS extension,
        'doc_' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '_v1' ELSE '_v2' END || (['.txt','.md','.docx','.pdf','.xlsx','.html','.json','.log'])[doc_id % 8 + 1] AS filename,
        '/corpus/' || coalesce(lang, 'und') || '/' || coalesce(source, 'none') AS folder_path,
        TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS modified_at, n_chars AS size_bytes,
        CASE WHEN doc_id % 17 = 0 THEN 'ERROR' WHEN doc_id % 23 = 0 THEN 'SKIPPED' WHEN doc_id % 11 = 0 THEN 'PENDING' ELSE 'SUCCESS' END AS extract_status,
        CASE WHEN doc_id % 17 = 0 THEN (['TOO_LARGE','ENCRYPTED','PARSE_ERROR'])[doc_id % 3 + 1] END AS error_code
      FROM documents)))"""
CHUNKS_SQL = """chunks AS (
  SELECT file_id, filename, folder_path, CAST(i AS INT) AS chunk_index, substr(text, i * 1000 + 1, 1000) AS text, i * 1000 AS start_offset,
    substr(sha256(file_id || ':' || i), 1, 16) AS chunk_id, sha256(substr(text, i * 1000 + 1, 1000)) AS content_hash
  FROM (SELECT *, unnest(range(0, least(500, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM files))"""
#: All chunks, however long the text is.
WHOLE_CHUNKS_SQL = CHUNKS_SQL.replace("least(500, CAST(ceil(length(text) / 1000.0) AS BIGINT))", "CAST(ceil(length(text) / 1000.0) AS BIGINT)")
CLICKS_SQL = """click_log AS (
  SELECT event_id, user_id, ts, event_type, 'q' || CAST(CAST(floor(coalesce(value, 0)) AS BIGINT) % 20 AS VARCHAR) AS query,
    event_id % (SELECT count(*) FROM documents) AS doc_id, CAST(event_id % 10 AS INT) AS position
  FROM events WHERE event_type IN ('click', 'view'))"""
LOG_SQL = """extracts AS (
  SELECT path, extension AS ext, size_bytes, CAST(size_bytes % 997 AS DOUBLE) AS ms,
    CASE WHEN doc_id % 17 = 0 THEN 'error:PARSE_ERROR' WHEN doc_id % 23 = 0 THEN 'skip_cloud' ELSE 'ok' END AS result FROM files
), details AS (
  SELECT extension AS ext, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'parse' ELSE 'join' END AS stage, CAST(size_bytes % 331 AS DOUBLE) AS ms FROM files)"""
