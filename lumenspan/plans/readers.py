"""Registered queries of the file readers: every document becomes a file of some format, and is read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import compose, scan, store
from ..sources import corpus as T
from ..sources.extract import OLE_MAGIC
from ..streaming import jobs
from .catalogue import register

FORMATS = list(compose.WRITERS)


def _composed(spark, sf_dir):
    """Each document as a file: doc_id, extension, content; formats take turns by id."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.get(F.array(*map(F.lit, FORMATS)), (F.col("doc_id") % len(FORMATS)).cast("int")).alias("extension"), "text")

    def write(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = [compose.WRITERS[e](t.split("\n")) for e, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["doc_id", "extension", "content"])

    return docs.mapInArrow(write, "doc_id long, extension string, content binary")


JOINED = "array_to_string(list_filter(l, lambda x: trim(x) <> ''), chr(10))"
BARE = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"
LETTERS = "length(regexp_replace(b, '[^\\p{L}]', '', 'g'))"


@register(
    f"""SELECT doc_id, ext AS extension, CASE ext
  WHEN '.txt' THEN t WHEN '.html' THEN trim(regexp_replace(array_to_string(l, ' '), '\\s+', ' ', 'g'))
  WHEN '.docx' THEN CASE WHEN {JOINED} = '' THEN '' ELSE {JOINED} || chr(10) END
  WHEN '.xlsx' THEN CASE WHEN {JOINED} = '' THEN '' ELSE '[One]' || chr(10) || array_to_string(list_transform(list_filter(l, lambda x: trim(x) <> ''), lambda x: replace(trim(x), ' ', chr(9))), chr(10)) || chr(10) || chr(10) END
  WHEN '.pptx' THEN coalesce(array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: trim(x[1]) <> ''), lambda x: '[Slide ' || x[2] || ']' || chr(10) || x[1] || chr(10)), ''), '')
  WHEN '.odt' THEN CASE WHEN b <> '' THEN regexp_replace(b, '\\n{{3,}}', chr(10) || chr(10), 'g') END
  WHEN '.rtf' THEN regexp_replace(b, '\\n{{3,}}', chr(10) || chr(10), 'g')
  WHEN '.hwpx' THEN CASE WHEN {JOINED} = '' THEN '' ELSE array_to_string(list_transform(list_filter(l, lambda x: trim(x) <> ''), lambda x: trim(x)), chr(10)) || chr(10) END
  WHEN '.hwp' THEN t || chr(10)
  WHEN '.pdf' THEN CASE WHEN length(b) >= 50 AND {LETTERS} / length(b) < 0.2 THEN NULL WHEN b = '' THEN '' ELSE b || chr(10) END END AS text,
  CASE ext WHEN '.xlsx' THEN 'sheet' WHEN '.pptx' THEN 'slide' WHEN '.odt' THEN CASE WHEN b <> '' THEN 'text' END WHEN '.pdf' THEN CASE WHEN length(b) >= 50 AND {LETTERS} / length(b) < 0.2 THEN NULL ELSE 'text' END ELSE 'text' END AS source_type,
  CASE ext WHEN '.odt' THEN CASE WHEN b = '' THEN 'EMPTY' END WHEN '.pdf' THEN CASE WHEN length(b) >= 50 AND {LETTERS} / length(b) < 0.2 THEN 'GARBLED_TEXT' END END AS error_code
FROM (SELECT *, {BARE} AS b FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l, ({FORMATS!r})[doc_id % {len(FORMATS)} + 1] AS ext FROM documents))"""
)
def read_formats(spark, sf_dir):
    """SRC3-SRC13, FN24, FN31: whole documents through every format's writer and reader."""
    return scan.with_text(_composed(spark, sf_dir)).select("doc_id", "extension", "text", "source_type", "error_code")


FAILURES = [
    (".exe", b"x", "UNSUPPORTED"),
    (".eml", b"x", "UNSUPPORTED_IN_PIPELINE"),
    (".txt", None, "FILE_NOT_FOUND"),
    (".docx", b"no zip", "INVALID_ZIP"),
    (".xlsx", OLE_MAGIC + b"\0" * 600, "ENCRYPTED"),
    (".odt", compose.zipped({"x": ""}), "INVALID_ODF"),
    (".odp", compose.zipped({"content.xml": "<a"}), "PARSE_ERROR"),
    (".ods", compose.zipped({"content.xml": "<a/>"}), "EMPTY"),
    (".pdf", b"nothing", "PARSE_ERROR"),
    (".hwp", b"nothing", "PARSE_ERROR"),
    (".pdf", compose.pdf(["#%$ 12 " * 20]), "GARBLED_TEXT"),
]


@register(f"SELECT doc_id, ({[c for _, _, c in FAILURES]!r})[doc_id % {len(FAILURES)} + 1] AS error_code, false AS success FROM documents")
def read_failures(spark, sf_dir):
    """SRC13: what each kind of broken file is reported as."""
    k = (F.col("doc_id") % len(FAILURES)).cast("int")
    bad = F.get(F.array(*[F.unhex(F.lit(d.hex())) if d is not None else F.lit(None).cast("binary") for _, d, _ in FAILURES]), k)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*[F.lit(e) for e, _, _ in FAILURES]), k).alias("extension"), bad.alias("content"))
    return scan.with_text(docs).select("doc_id", "error_code", "success")


# -- trees of files ------------------------------------------------------------------

FOLDERS = ["Reports", "Reports/old", "node_modules/x", ".hidden", "Projects"]


def _placed(spark, sf_dir, root: str):
    """Every document as a text file in some folder below ``root``: doc_id, path, content."""
    folder = F.get(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS)).cast("int"))
    path = F.concat(F.lit(f"{root}/"), folder, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return T.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))


def _tree(spark, sf_dir) -> str:
    """Every document as a text file in some folder of a tree in the shared folder; written once for a table."""
    root = f"{store.shared_dir(spark)}/lumenspan-tree/{store.stamp(spark, f'{sf_dir}/documents.parquet')}"
    if not store.exists(spark, f"{root}.done"):
        scan.write_files(_placed(spark, sf_dir, root))
        spark.range(1).write.mode("overwrite").parquet(f"{root}.done")
    return root


TREE_SQL = f"tree AS (SELECT ({FOLDERS!r})[doc_id % {len(FOLDERS)} + 1] AS folder, coalesce(text, '') || chr(10) AS t FROM documents WHERE doc_id % {len(FOLDERS)} NOT IN (2, 3) AND strlen(coalesce(text, '')) + 1 >= 10)"


@register("SELECT folder, '.txt' AS extension, count(*) AS n, CAST(sum(strlen(t)) AS BIGINT) AS bytes, bit_xor(('0x' || left(md5(t), 8))::BIGINT) AS mark FROM tree GROUP BY folder", TREE_SQL)
def scan_tree(spark, sf_dir):
    """SRC1, SRC3, SRC13, FLT1, FLT2: files below a root that are worth a look, with their contents."""
    root = _tree(spark, sf_dir)
    found = scan.with_text(scan.scan(spark, root, content=True))
    folder = F.regexp_replace(F.col("folder_path"), f"^.*{root.rsplit('/', 1)[1]}/", "")
    return found.groupBy(folder.alias("folder"), "extension").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.bit_xor(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("mark"))


@register("SELECT count(*) AS files, CAST(sum(ceil(length(t) / 1000.0)) AS BIGINT) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chars FROM tree", TREE_SQL)
def stream_ingest(spark, sf_dir):
    """STR1, STR3, API7: a streaming job that reads new files whole, and a second cycle that finds none."""
    root, out = _tree(spark, sf_dir), f"{store.shared_dir(spark)}/lumenspan-ingest-whole/{store.stamp(spark, f'{sf_dir}/documents.parquet')}"
    for _ in range(2):
        jobs.ingest(spark, root, f"{out}/tables", f"{out}/mark").awaitTermination()
    files, chunks = jobs.tables(spark, f"{out}/tables")
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")))  # one row each


@register(
    """SELECT doc_id, count(*) AS chunks, CAST(sum(length(c)) AS BIGINT) AS chars, bit_xor(('0x' || left(md5(c), 8))::BIGINT) AS mark
FROM (SELECT doc_id, substr(t, i * 1000 + 1, 1000) AS c FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1000.0) AS BIGINT))) AS i FROM (
  SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'new ' ELSE '' END || coalesce(text, '') || chr(10) AS t FROM documents WHERE doc_id % 5 NOT IN (2, 3) AND doc_id % 10 <> 5) WHERE strlen(t) >= 10))
GROUP BY doc_id"""
)
def stream_changes(spark, sf_dir):
    """STR1, STR2, SRC1, FLT2: the chunks of whole texts of a tree after two cycles: between them a tenth of the files was rewritten, a tenth deleted, a tenth came in; skipped folders stay unseen."""
    home = f"{store.shared_dir(spark)}/lumenspan-changes/{uuid.uuid4().hex}"
    fs, where = store.filesystem(spark, home)
    fs.deleteOnExit(where)
    docs, kind = _placed(spark, sf_dir, f"{home}/root"), F.col("doc_id") % 10
    now = F.when(kind == 4, F.concat(F.lit("new "), F.col("content"))).when(kind != 5, F.col("content"))
    for files in (docs.where(kind != 1), docs.where(kind.isin(1, 4, 5)).withColumn("content", now)):
        scan.write_files(files)
        jobs.ingest(spark, f"{home}/root", f"{home}/tables", f"{home}/mark", delete=True).awaitTermination()
    _, chunks = jobs.tables(spark, f"{home}/tables")
    doc = F.regexp_extract("filename", "doc_(\\d+)", 1).cast("long").alias("doc_id")
    return chunks.groupBy(doc).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.bit_xor(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("mark"))


@register("SELECT extension, result, count(*) AS n FROM (SELECT extension, CASE WHEN doc_id % 7 = 0 THEN 'PARSE_ERROR' ELSE 'SUCCESS' END AS result FROM (SELECT doc_id, n_chars, (['.txt', '.md', '.csv'])[doc_id % 3 + 1] AS extension FROM documents) WHERE extension IN ('.txt', '.csv') AND n_chars <= 5000) GROUP BY 1, 2")
def dump_summary(spark, sf_dir):
    """SNK14, AGG22, FN35: the dump's summary by extension and result."""
    d = F.col("doc_id")
    docs = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), d.cast("string")).alias("path"), F.get(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".csv")), (d % 3).cast("int")).alias("extension"), F.col("n_chars").alias("size_bytes"), "text", (d % 7 != 0).alias("success"), F.when(d % 7 == 0, "PARSE_ERROR").alias("error_code"))
    out = f"{store.shared_dir(spark)}/lumenspan-dump/{store.stamp(spark, f'{sf_dir}/documents.parquet')}"
    return scan.dump(docs, out, only=["txt", ".CSV"], max_size=scan.parse_size("5000B"))
