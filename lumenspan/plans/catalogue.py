"""Registered queries of the search engine's operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words
from ..functions.query import All, Any, Atom
from ..operators import catalogue as C
from ..operators import chunks as K
from ..operators import dense as D
from ..operators import feedback as B
from ..operators import index as I
from ..operators import logs as L
from ..operators import mutations as M
from ..operators import results as R
from ..operators import search as S
from ..operators import substrings as G
from ..sources import corpus as T
from ..sources import store
from ..sources.corpus import AS_OF, CHUNKS_SQL, CLICKS_SQL, FILES_SQL, LOG_SQL, WHOLE_CHUNKS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


DAYS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified_at)) / 86400e6"
RECENCY = f"greatest(0.3, 1 / (1 + {DAYS} / 365))"


def register(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql  # sql may go on with ", name AS (...)"
        return f

    return keep


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


# -- full text ----------------------------------------------------------------


def _terms_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def _count_sql(atom: Atom, terms: str) -> str:
    parts = atom.text.split(" ")
    one = [f"starts_with({{x}}, '{p}')" if atom.prefix and k == len(parts) - 1 else f"{{x}} = '{p}'" for k, p in enumerate(parts)]
    if len(parts) == 1:
        return f"len(list_filter({terms}, lambda x: {one[0].format(x='x')}))"
    both = " AND ".join(o.format(x=f"{terms}[i + {k + 1}]") for k, o in enumerate(one))
    return f"len(list_filter(range(0, greatest(0, len({terms}) - {len(parts) - 1})), lambda i: {both}))"


def bm25_ctes(found: list[Atom], where: str) -> str:
    """``scored``: matching chunks with bm25 and match_source."""
    n = range(len(found))
    counts = ", ".join(f"{_count_sql(a, t)} AS {t}{i}" for i, a in enumerate(found) for t in ("a", "b", "c"))
    f = [f"(1.0 * a{i} + 3.0 * b{i} + 1.0 * c{i})" for i in n]
    hit = {f"h{i}": f"(a{i} + b{i} + c{i} > 0)" for i in n}
    for k, v in hit.items():
        where = where.replace(f"{{{k}}}", v)
    idf = [f"greatest(1e-6, ln((rows_ - df{i} + 0.5) / (df{i} + 0.5)))" for i in n]
    score = " + ".join(f"{idf[i]} * {f[i]} * 2.2 / ({f[i]} + 1.2 * (0.25 + 0.75 * long_ / average_))" for i in n)
    source = " | ".join(f"CASE WHEN {' OR '.join(f'{t}{i} > 0' for i in n)} THEN {bit} ELSE 0 END" for t, bit in (("a", 2), ("b", 1), ("c", 4)))
    return f"""split_ AS (SELECT *, {_terms_sql('text')} AS a, {_terms_sql('filename')} AS b, {_terms_sql('folder_path')} AS c FROM chunks),
counted AS (SELECT file_id, chunk_id, chunk_index, len(a) + len(b) + len(c) AS long_, {counts} FROM split_),
corpus AS (SELECT count(*) AS rows_, avg(long_) AS average_, {', '.join(f'count(*) FILTER ({v}) AS df{k[1:]}' for k, v in hit.items())} FROM counted),
scored AS (SELECT file_id, chunk_id, chunk_index, {score} AS bm25, {source} AS match_source FROM counted, corpus WHERE {where})"""


OR_TERMS = Any((Atom("erin"), Atom("pour")))
AND_TERMS = All((Atom("erin"), Atom("thing", True)))
PHRASE = Any((Atom("of the"), Atom("sich")))
SIMPLE = S.Options(top=20, per_file=1, tokenizer="simple")
TOP_SQL = "SELECT file_id, chunk_id, round(bm25, 6) AS bm25, match_source FROM scored ORDER BY bm25 DESC, chunk_id LIMIT 60"


def index(spark: SparkSession, sf_dir: str, tokenizer: str = "simple", whole: bool = False) -> I.Index:
    """The stored index of a corpus in the shared folder, built on first use and whenever documents or version change; ``whole`` texts, else their first chunks."""
    at = f"{store.shared_dir(spark)}/lumenspan-index{'-whole' if whole else ''}/{store.stamp(spark, f'{sf_dir}/documents.parquet')}"
    return I.ensure(spark, at, lambda: T.chunks(spark, sf_dir, None if whole else K.MOST), tokenizer)


def _top_chunks(spark: SparkSession, sf_dir: str, query, stored: bool = True, whole: bool = False) -> DataFrame:
    if stored:
        best = index(spark, sf_dir, whole=whole).top(query, S.most_candidates(SIMPLE), 6)
    else:
        best = S.candidates(S.bm25(T.chunks(spark, sf_dir), query, "simple").withColumn("bm25", F.round("bm25", 6)), SIMPLE)
    return best.select("file_id", "chunk_id", "bm25", "match_source")


@register(TOP_SQL, FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"))
def fts_bm25_or(spark, sf_dir):
    """FTS2, FTS4-FTS7, AGG24, TOP1: any of two terms."""
    return _top_chunks(spark, sf_dir, OR_TERMS)


@register(TOP_SQL, FILES_SQL, WHOLE_CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("thing", True)], "{h0} AND {h1}"))
def fts_bm25_and_prefix(spark, sf_dir):
    """FTS3, FTS4: a term and a prefix, in whole texts."""
    return _top_chunks(spark, sf_dir, AND_TERMS, whole=True)


@register(TOP_SQL, FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("of the"), Atom("sich")], "{h0} OR {h1}"))
def fts_bm25_phrase(spark, sf_dir):
    """FTS2: a phrase or a term."""
    return _top_chunks(spark, sf_dir, PHRASE)


@register(TOP_SQL, FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("thing", True)], "{h0} AND {h1}"))
def fts_scan(spark, sf_dir):
    """FTS1-FTS7 without an index: for tables that are searched once."""
    return _top_chunks(spark, sf_dir, AND_TERMS, False)


@register(TOP_SQL, FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("of the thi", True)], "{h0} OR {h1}"))
def fts_bm25_phrase_prefix(spark, sf_dir):
    """FTS2, FTS3: a phrase whose last term goes on."""
    return _top_chunks(spark, sf_dir, Any((Atom("erin"), Atom("of the thi", True))))


@register(
    "SELECT file_id, count(*) AS match_count, min(chunk_index) AS first_match FROM scored JOIN files USING (file_id) WHERE extension = '.docx' GROUP BY file_id",
    FILES_SQL,
    CHUNKS_SQL,
    bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"),
)
def fts_match_counts(spark, sf_dir):
    """AGG4, JN2: matching chunks per file of a set."""
    some = T.files(spark, sf_dir).where("extension = '.docx'")
    return S.match_counts(T.chunks(spark, sf_dir), OR_TERMS, some, "simple")


BOUNCE_SQL = """nexts AS (SELECT *, lead(event_type) OVER w AS nt, lead(ts) OVER w AS nts, lead(query) OVER w AS nq FROM click_log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
bounced AS (SELECT *, coalesce(nt = 'view' AND (epoch_us(nts) - epoch_us(ts)) / 1e6 <= 1800 AND NOT (starts_with(query, nq) OR starts_with(nq, query)), false) AS is_bounce FROM nexts WHERE event_type = 'click'),
clicks AS (SELECT b.query, lower(f.path) AS path_key, count(*) AS click_count, max(ts) AS last_clicked, min(position) AS position, bool_or(is_bounce) AS is_bounce FROM bounced b JOIN files f USING (doc_id) GROUP BY 1, 2)"""
BOOST_SQL = "CASE " + " ".join(f"WHEN lower(extension) = '{e}' THEN {b}" for e, b in words.EXTENSION_BOOST.items()) + " ELSE 1.0 END"
BEST_SQL = f"""candidates AS (SELECT *, round(bm25, 6) AS raw FROM scored ORDER BY bm25 DESC, chunk_id LIMIT 60),
ranked AS (
  SELECT c.file_id, c.chunk_id, c.match_source, f.path, c.bm25 AS raw_bm25,
    c.bm25 * {RECENCY} * {BOOST_SQL} AS score
  FROM candidates c JOIN files f USING (file_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, raw_bm25 DESC, chunk_id) AS n FROM ranked)"""


@register("SELECT file_id, path, chunk_id, match_source, round(score, 6) AS score FROM best WHERE n = 1 ORDER BY score DESC, file_id LIMIT 20", FILES_SQL, CHUNKS_SQL, bm25_ctes([Atom("erin"), Atom("pour", True)], "{h0} OR {h1}"), BEST_SQL)
def fts_bm25_topk(spark, sf_dir):
    """Flagship: best files for two words, with recency and extension boosts, one chunk a file (FTS10-FTS12, AGG6, TOP2)."""
    files = T.files(spark, sf_dir)
    best = index(spark, sf_dir).top(Any((Atom("erin"), Atom("pour", True))), S.most_candidates(SIMPLE))
    out = S.best_per_file(S.score_hits(best, files, ["erin", "pour"], now()), SIMPLE)
    return out.select("file_id", "path", "chunk_id", "match_source", F.round("score", 6).alias("score"))


@register(
    "SELECT file_id, path, chunk_id, match_source, round(click_boost, 6) AS click_boost, round(score, 6) AS score FROM boosted_best WHERE n = 1 ORDER BY score DESC, file_id LIMIT 20",
    FILES_SQL,
    CHUNKS_SQL,
    CLICKS_SQL,
    BOUNCE_SQL,
    bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"),
    f"""candidates AS (SELECT * FROM scored ORDER BY bm25 DESC, chunk_id LIMIT 60),
boosts AS (SELECT path_key, CASE WHEN is_bounce THEN 0.0 ELSE least(1.0, least(1.0, 0.1 * click_count) * log2(position + 2.0)) END AS click_boost FROM clicks WHERE query = 'q7'),
ranked AS (SELECT c.file_id, c.chunk_id, c.match_source, f.path, c.bm25 AS raw_bm25, coalesce(b.click_boost, 0.0) AS click_boost,
  c.bm25 * {RECENCY} * {BOOST_SQL} * (1 + coalesce(b.click_boost, 0.0)) + CASE WHEN regexp_matches(f.filename, '(^|[^\\p{{L}}\\p{{N}}])v1($|[^\\p{{L}}\\p{{N}}])') THEN 0.5 ELSE 0.0 END AS score
  FROM candidates c JOIN files f USING (file_id) LEFT JOIN boosts b ON b.path_key = lower(f.path)),
boosted_best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, raw_bm25 DESC, chunk_id) AS n FROM ranked)""",
)
def fts_click_boost(spark, sf_dir):
    """JN9, FTS10, FTS13: a search with the click boosts of a query, and half a point for a word that stands in the file name by itself."""
    files, boosts = T.files(spark, sf_dir), B.boosts(_clicks(spark, sf_dir), "q7")
    best = index(spark, sf_dir).top(OR_TERMS, S.most_candidates(SIMPLE))
    out = S.best_per_file(S.score_hits(best, files, ["v1"], now(), boosts), SIMPLE)
    return out.select("file_id", "path", "chunk_id", "match_source", six("click_boost"), six("score"))


@register(
    """SELECT label, list(round(CASE WHEN norm > 0 THEN m / norm ELSE 0 END, 6) ORDER BY i) AS vector, max(n) AS n
FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS norm FROM (
  SELECT label, i, coalesce(avg(x) FILTER (own), 0.0) AS m, count(*) FILTER (own) AS n
  FROM (SELECT label, vec_id % 3 <> 0 AS own, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY label, i))
GROUP BY label"""
)
def pooled_vectors(spark, sf_dir):
    """FN26: the masked mean of vectors, scaled to length one."""
    e = T.embeddings(spark, sf_dir).withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return D.pooled(e, "label").select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "n")


@register(
    "SELECT file_id, path FROM files WHERE len(list_filter(regexp_extract_all(lower(filename), '[\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'docx'))) + len(list_filter(regexp_extract_all(lower(path), '[\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'docx'))) > 0 ORDER BY modified_at DESC, path LIMIT 20",
    FILES_SQL,
)
def fts_filename(spark, sf_dir):
    """FTS8, JN7, TOP6"""
    return S.filename_matches(T.files(spark, sf_dir), "docx", 20, "simple").select("file_id", "path")


@register(f"SELECT file_id, round({RECENCY}, 6) AS recency, {BOOST_SQL} AS ext_boost FROM files", FILES_SQL)
def fts_boosts(spark, sf_dir):
    """FTS11, FTS12"""
    return T.files(spark, sf_dir).select("file_id", F.round(X.recency_boost(F.col("modified_at"), now()), 6).alias("recency"), X.extension_boost(F.col("extension")).alias("ext_boost"))


@register("SELECT file_id, regexp_matches(filename, '(^|[^\\p{L}\\p{N}])v1($|[^\\p{L}\\p{N}])') AS v1 FROM files", FILES_SQL)
def fts_word_boundary(spark, sf_dir):
    """FTS14"""
    return T.files(spark, sf_dir).select("file_id", X.word_boundary_match(F.col("filename"), "v1").alias("v1"))


# -- catalogue ----------------------------------------------------------------

CONTENT_SQL = "(" + ", ".join(f"'{e}'" for e in words.CONTENT_EXTENSIONS) + ")"


@register("SELECT file_id, path, extension, CAST(size_bytes AS BIGINT) AS size_bytes, extract_status FROM files", FILES_SQL)
def src_files(spark, sf_dir):
    """SRC16, FN1: the file table and its ids."""
    return T.files(spark, sf_dir).select("file_id", "path", "extension", "size_bytes", "extract_status")


@register("SELECT file_id, chunk_id, chunk_index, content_hash, CAST(start_offset AS BIGINT) AS start_offset, length(text) AS n_chars FROM chunks", FILES_SQL, CHUNKS_SQL)
def chunk_slices(spark, sf_dir):
    """FN20, FN1, TOP13"""
    return T.chunks(spark, sf_dir).select("file_id", "chunk_id", "chunk_index", "content_hash", "start_offset", F.length("text").cast("long").alias("n_chars"))


PARAGRAPHS_SQL = """RECURSIVE parts AS (SELECT doc_id, n, part, length(part) AS len, CAST(coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM (SELECT doc_id, unnest(l) AS part, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''))),
steps AS (
  SELECT doc_id, n, len > 0 AND len <= 1000 AS open, CASE WHEN len <= 1000 THEN len ELSE 0 END AS long, CASE WHEN len > 0 AND len <= 1000 THEN n END AS g FROM parts WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, p.len <= 1000 AND (p.len > 0 OR s.open AND s.long + 2 + p.len <= 1000),
    CASE WHEN p.len > 1000 THEN 0 WHEN s.open AND s.long + 2 + p.len <= 1000 THEN s.long + 2 + p.len ELSE p.len END,
    CASE WHEN p.len > 1000 THEN NULL WHEN s.open AND s.long + 2 + p.len <= 1000 THEN s.g WHEN p.len > 0 THEN p.n END
  FROM steps s JOIN parts p ON p.doc_id = s.doc_id AND p.n = s.n + 1)"""


@register(
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) - 1 AS INT) AS chunk_index, start_offset, length(text) AS n_chars, md5(text) AS mark FROM (
  SELECT doc_id, min(begins) AS start_offset, string_agg(part, chr(10) || chr(10) ORDER BY n) AS text FROM parts JOIN steps USING (doc_id, n) WHERE g IS NOT NULL GROUP BY doc_id, g
  UNION ALL SELECT doc_id, begins + i * 1000, substr(part, i * 1000 + 1, 1000) FROM (SELECT *, unnest(range(0, CAST(ceil(len / 1000.0) AS BIGINT))) AS i FROM parts WHERE len > 1000))
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) <= 500""",
    PARAGRAPHS_SQL,
)
def chunk_paragraphs(spark, sf_dir):
    """FN20, TOP13: whole paragraphs packed up to a thousand characters, longer ones cut; every line of a text is a paragraph, apart by blank lines of either kind."""
    docs = T.table(spark, sf_dir, "documents")
    apart = F.when(F.col("doc_id") % 2 == 0, "\n\n").otherwise("\r\n\r\n")
    found = K.chunk_files(docs.select("doc_id", F.replace(F.col("text"), F.lit("\n"), apart).alias("text")))
    return found.select("doc_id", "chunk_index", "start_offset", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("mark"))


@register("SELECT content_hash, count(*) AS copies, min(chunk_id) AS first_chunk FROM chunks GROUP BY content_hash HAVING count(*) > 1", FILES_SQL, CHUNKS_SQL)
def chunk_duplicates(spark, sf_dir):
    """Copies by content hash."""
    return C.duplicates(T.chunks(spark, sf_dir))


@register("SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*) AS n_chunks, sum(length(text)) > 1048576 AS truncated FROM chunks GROUP BY file_id", FILES_SQL, CHUNKS_SQL)
def file_content(spark, sf_dir):
    """FN34, TOP7, API2"""
    return K.file_content(T.chunks(spark, sf_dir))


@register(f"SELECT file_id, path FROM files WHERE extract_status = 'PENDING' AND extension IN {CONTENT_SQL} ORDER BY path LIMIT 500", FILES_SQL)
def pending_work(spark, sf_dir):
    """FLT6, SRC14"""
    return C.pending(T.files(spark, sf_dir)).select("file_id", "path")


@register("SELECT file_id, path FROM files WHERE starts_with(lower(path), '/corpus/en/src1') AND extension = '.md' ORDER BY modified_at DESC, path LIMIT 50", FILES_SQL)
def list_files(spark, sf_dir):
    """FLT7, FLT8, TOP6, API3"""
    return C.listing(T.files(spark, sf_dir), "/Corpus/EN/src1", "md").select("file_id", "path")


@register("SELECT file_id, path FROM files WHERE (filename ILIKE '%doc_1%' OR path ILIKE '%doc_1%') AND (filename ILIKE '%v2%' OR path ILIKE '%v2%') ORDER BY modified_at DESC, path LIMIT 20", FILES_SQL)
def filename_like(spark, sf_dir):
    """FLT9, Q14"""
    return C.filename_search(T.files(spark, sf_dir), ["doc_1", "v2"]).select("file_id", "path")


@register("SELECT file_id, path FROM files WHERE filename ILIKE '%src3%' OR path ILIKE '%src3%' OR filename ILIKE '%doc_7%' OR path ILIKE '%doc_7%' ORDER BY modified_at DESC, path LIMIT 20", FILES_SQL)
def quick_search(spark, sf_dir):
    """FLT10, API6"""
    return C.quick_search(T.files(spark, sf_dir), "src3, doc_7").select("file_id", "path")


def _substrings(spark: SparkSession, sf_dir: str) -> G.Substrings:
    """Trigrams of all names and paths in the shared folder, built on first use."""
    at = f"{store.shared_dir(spark)}/lumenspan-grams/{store.stamp(spark, f'{sf_dir}/documents.parquet')}"
    if not G.exists(spark, at):
        G.build(T.files(spark, sf_dir), at)
    return G.Substrings(spark, at)


@register("SELECT file_id, path FROM files WHERE (contains(lower(filename), 'doc_1') OR contains(lower(path), 'doc_1')) AND contains(lower(path), '2') AND contains(lower(path), 'us/en') ORDER BY modified_at DESC, path LIMIT 20", FILES_SQL)
def filename_like_stored(spark, sf_dir):
    """FLT9, FTS8 by trigrams: every word in name or path, one of them a single letter; only candidates are read."""
    return _substrings(spark, sf_dir).search(T.files(spark, sf_dir), ["Doc_1", "2", "us/EN"]).select("file_id", "path")


@register("SELECT file_id, path FROM files WHERE contains(lower(path), 'src3') OR contains(lower(path), 'doc_7') OR contains(lower(path), 'no such name') ORDER BY modified_at DESC, path LIMIT 20", FILES_SQL)
def quick_search_stored(spark, sf_dir):
    """FLT10, API6 by trigrams: any word in name or path."""
    return _substrings(spark, sf_dir).search(T.files(spark, sf_dir), ["src3", "doc_7", "no such name"], every=False).select("file_id", "path")


@register("SELECT file_id FROM files WHERE extension IN ('.txt', '.md', '.log') AND modified_at >= TIMESTAMP '2024-07-01' - INTERVAL 200 DAY AND year(modified_at) = 2024", FILES_SQL)
def type_and_date_filter(spark, sf_dir):
    """FLT12, FLT13"""
    return T.files(spark, sf_dir).where(C.of_type("txt") & C.since("year", now()) & (F.col("modified_at") >= now() - F.expr("interval 200 days"))).select("file_id")


@register("SELECT file_id FROM files WHERE modified_at >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAY", FILES_SQL)
def recent_filter(spark, sf_dir):
    """FLT13"""
    return T.files(spark, sf_dir).where(C.since("30d", F.lit("2024-01-20").cast("timestamp_ntz"))).select("file_id")


@register("SELECT file_id FROM files WHERE size_bytes BETWEEN 10 AND 500000000 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0", FILES_SQL)
def scan_filter(spark, sf_dir):
    """FLT1"""
    return T.files(spark, sf_dir).where(C.scannable(F.col("size_bytes"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0)).select("file_id")


@register(
    "SELECT file_id FROM files WHERE NOT (doc_id % 4 = 0 OR doc_id % 9 = 0)",
    FILES_SQL,
)
def folder_filter(spark, sf_dir):
    """FLT2, FLT3: files below folders that are scanned."""
    under = F.when(F.col("doc_id") % 4 == 0, "/x/node_modules/a").when(F.col("doc_id") % 9 == 0, "/x/0123456789abcdef01").otherwise("/x/Reports")
    return T.files(spark, sf_dir).where(~C.in_skipped_folder(under)).select("file_id")


@register("SELECT doc_id FROM files WHERE (doc_id * 4096) & 4096 <> 0 OR doc_id % 3 = 0", FILES_SQL)
def cloud_files(spark, sf_dir):
    """FLT4"""
    bits = F.when(F.col("doc_id") % 3 == 0, F.lit(0x400000)).otherwise((F.col("doc_id") * 4096).bitwiseAND(F.lit(4096)))
    return T.files(spark, sf_dir).where(C.cloud_placeholder(bits.cast("long"))).select("doc_id")


@register("SELECT file_id, path FROM files WHERE doc_id % 6 = 0 OR doc_id % 10 = 0", FILES_SQL)
def scan_diff(spark, sf_dir):
    """FLT5, JN13, STR2: files that are new or whose time changed."""
    known = T.files(spark, sf_dir).where("doc_id % 6 <> 0").withColumn("path", F.upper("path"))
    scanned = T.files(spark, sf_dir).withColumn("modified_at", F.when(F.col("doc_id") % 10 == 0, F.col("modified_at") + F.expr("interval 1 second")).otherwise(F.col("modified_at")))
    return C.changed(scanned, known).select("file_id", "path")


@register(
    f"SELECT count(*) AS files, count(DISTINCT folder_path) AS folders, count(*) FILTER (ok AND extract_status <> 'SKIPPED') AS searchable, count(*) FILTER (ok AND extract_status = 'PENDING') AS pending, count(*) FILTER (ok AND extract_status = 'SUCCESS') AS indexed FROM (SELECT *, extension IN {CONTENT_SQL} AS ok FROM files)",
    FILES_SQL,
)
def scan_totals(spark, sf_dir):
    """AGG1, AGG2"""
    return C.totals(T.files(spark, sf_dir))


@register(
    "SELECT count(*) FILTER (extract_status = 'SKIPPED') AS cloud, count(*) FILTER (error_code = 'TOO_LARGE') AS too_large, count(*) FILTER (error_code = 'ENCRYPTED') AS encrypted, count(*) FILTER (extract_status = 'ERROR' AND coalesce(error_code, '') NOT IN ('TOO_LARGE', 'ENCRYPTED')) AS parse_error FROM files",
    FILES_SQL,
)
def skip_categories(spark, sf_dir):
    """AGG3, Q5"""
    return C.skip_counts(T.files(spark, sf_dir))


@register("SELECT folder_path, round(least(100.0, 100.0 * count(*) FILTER (extract_status = 'SUCCESS') / count(*)), 6) AS percent FROM files GROUP BY folder_path", FILES_SQL)
def coverage(spark, sf_dir):
    """AGG23"""
    n = T.files(spark, sf_dir).groupBy("folder_path").agg(F.count_if(F.col("extract_status") == "SUCCESS").alias("a"), F.count("*").alias("b"))
    return n.select("folder_path", F.round(C.percent(F.col("a"), F.col("b")), 6).alias("percent"))


EMBEDDED_SQL = "embedded AS (SELECT f.file_id, CAST(0 AS INT) AS chunk_index, e.vec_id, e.embedding FROM embeddings e JOIN files f ON f.doc_id = e.vec_id)"


def _embedded(spark, sf_dir) -> DataFrame:
    e = T.embeddings(spark, sf_dir)
    return e.join(T.files(spark, sf_dir), e["vec_id"] == F.col("doc_id")).select("file_id", F.lit(0).alias("chunk_index"), "vec_id", "embedding")


@register("SELECT c.file_id, c.chunk_index FROM chunks c ANTI JOIN embedded e USING (file_id, chunk_index) WHERE length(c.text) > 0", FILES_SQL, CHUNKS_SQL, EMBEDDED_SQL)
def missing_embeddings(spark, sf_dir):
    """JN4, FLT17, STR10"""
    return C.missing_embeddings(T.chunks(spark, sf_dir), _embedded(spark, sf_dir)).select("file_id", "chunk_index")


@register("SELECT vec_id FROM embedded SEMI JOIN (SELECT file_id, chunk_index FROM chunks JOIN files USING (file_id) WHERE extension = '.pdf') k USING (file_id, chunk_index)", FILES_SQL, CHUNKS_SQL, EMBEDDED_SQL)
def embeddings_by_keys(spark, sf_dir):
    """JN5, JN6"""
    keys = T.chunks(spark, sf_dir).join(T.files(spark, sf_dir).where("extension = '.pdf'").select("file_id"), "file_id", "left_semi").select("file_id", "chunk_index")
    return C.by_keys(_embedded(spark, sf_dir), keys).select("vec_id")


# -- mutations ----------------------------------------------------------------


@register("SELECT file_id, CASE WHEN doc_id % 3 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, extract_status FROM files UNION ALL SELECT 'new' || doc_id, 7, 'PENDING' FROM files WHERE doc_id % 40 = 0", FILES_SQL)
def upsert_files(spark, sf_dir):
    """SNK1, SNK2, SNK7: changed sizes and new files put in by id."""
    f = T.files(spark, sf_dir).select("file_id", "doc_id", "size_bytes", "extract_status")
    changed = f.where("doc_id % 3 = 0").select("file_id", (F.col("size_bytes") + 1).alias("size_bytes"), "extract_status")
    new = f.where("doc_id % 40 = 0").select(F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("file_id"), F.lit(7).cast("long").alias("size_bytes"), F.lit("PENDING").alias("extract_status"))
    return M.upsert(f.drop("doc_id"), changed.unionByName(new), ["file_id"], "size_bytes")


@register("SELECT c.file_id, count(*) AS n FROM chunks c JOIN files f USING (file_id) WHERE f.doc_id % 5 <> 0 GROUP BY c.file_id", FILES_SQL, CHUNKS_SQL)
def delete_files(spark, sf_dir):
    """SNK4, SNK5, JN8: chunks that stay when files are deleted by path."""
    f = T.files(spark, sf_dir)
    left = M.delete_files({"files": f, "chunks": T.chunks(spark, sf_dir)}, f.where("doc_id % 5 = 0").select(F.upper("path").alias("path")))
    return left["chunks"].groupBy("file_id").agg(F.count("*").alias("n"))


@register("SELECT e.vec_id FROM embedded e JOIN files f USING (file_id) WHERE f.doc_id % 4 <> 0", FILES_SQL, EMBEDDED_SQL)
def stale_embeddings(spark, sf_dir):
    """SNK3, SNK9: vectors left after files were chunked anew."""
    return M.stale_embeddings(_embedded(spark, sf_dir), T.files(spark, sf_dir).where("doc_id % 4 = 0").select("file_id")).select("vec_id")


@register("SELECT file_id, CASE WHEN doc_id % 11 = 0 THEN 'SUCCESS' ELSE extract_status END AS extract_status, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE error_code END AS error_code FROM files", FILES_SQL)
def set_status(spark, sf_dir):
    """SNK6"""
    f = T.files(spark, sf_dir)
    done = f.where("doc_id % 11 = 0").select("file_id", F.lit("SUCCESS").alias("extract_status"), F.lit(None).cast("string").alias("error_code"))
    return M.set_status(f, done).select("file_id", "extract_status", "error_code")


# -- vectors ------------------------------------------------------------------

QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
SIM_SQL = f"list_dot_product(embedding::DOUBLE[], {VECTOR_SQL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL})))"


@register(f"SELECT vec_id, round({SIM_SQL}, 6) AS similarity FROM embeddings WHERE {SIM_SQL} >= 0.1 ORDER BY {SIM_SQL} DESC, vec_id LIMIT 20")
def dense_topk(spark, sf_dir):
    """TOP3, FLT14, FN25"""
    return D.similar(T.embeddings(spark, sf_dir), QUERY_VECTOR).select("vec_id", six("similarity"))


@register(
    """SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(similarity, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id, s.similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.similarity DESC, e.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id < 5) q, embeddings e,
  LATERAL (SELECT list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity) s
  WHERE s.similarity >= 0.1) WHERE rank <= 10"""
)
def dense_batch(spark, sf_dir):
    """TOP3 for a batch of five stated queries."""
    e = T.embeddings(spark, sf_dir)
    return D.similar_to(e, e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10).select("query_id", "rank", "vec_id", six("similarity"))


KEYWORD_SQL = "keyword AS (SELECT file_id, row_number() OVER (ORDER BY bm25 DESC, file_id) AS rank, round(bm25, 6) AS score FROM (SELECT file_id, max(bm25) AS bm25 FROM scored GROUP BY file_id) ORDER BY bm25 DESC, file_id LIMIT 50)"
DENSE_SQL = f"dense AS (SELECT file_id, row_number() OVER (ORDER BY {SIM_SQL} DESC, file_id) AS rank, round({SIM_SQL}, 6) AS score FROM embedded ORDER BY {SIM_SQL} DESC, file_id LIMIT 50)"


@register(
    "SELECT coalesce(k.file_id, d.file_id) AS file_id, coalesce(k.score, 0.0) AS keyword_score, coalesce(d.score, 0.0) AS dense_score, round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 6) AS hybrid_score FROM keyword k FULL JOIN dense d ON k.file_id = d.file_id ORDER BY coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) DESC, 1 LIMIT 20",
    FILES_SQL,
    CHUNKS_SQL,
    EMBEDDED_SQL,
    bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"),
    KEYWORD_SQL,
    DENSE_SQL,
)
def rrf_fusion(spark, sf_dir):
    """JN11, FN29, TOP5"""
    k = index(spark, sf_dir).search(OR_TERMS).groupBy("file_id").agg(F.max("bm25").alias("bm25")).orderBy(F.desc("bm25"), "file_id").limit(50)
    k = k.select("file_id", F.row_number().over(Window.orderBy(F.desc("bm25"), "file_id")).alias("rank"), F.round("bm25", 6).alias("score"))
    sim = X.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in QUERY_VECTOR]))
    d = _embedded(spark, sf_dir).withColumn("s", sim).orderBy(F.desc("s"), "file_id").limit(50)
    d = d.select("file_id", F.row_number().over(Window.orderBy(F.desc("s"), "file_id")).alias("rank"), F.round("s", 6).alias("score"))
    return D.fuse(k, d).withColumn("hybrid_score", F.round("hybrid_score", 6))


@register(
    f"""SELECT file_id, CAST(row_number() OVER (ORDER BY s DESC, rank) AS INT) AS dense_rank, round(s, 6) AS similarity
FROM (SELECT k.file_id, k.rank, {SIM_SQL} AS s FROM keyword k JOIN embedded e USING (file_id)) WHERE s >= 0.1""",
    FILES_SQL,
    CHUNKS_SQL,
    EMBEDDED_SQL,
    bm25_ctes([Atom("erin"), Atom("pour")], "{h0} OR {h1}"),
    KEYWORD_SQL,
)
def cascade_rerank(spark, sf_dir):
    """JN10, TOP4"""
    k = index(spark, sf_dir).search(OR_TERMS).groupBy("file_id").agg(F.max("bm25").alias("bm25")).orderBy(F.desc("bm25"), "file_id").limit(50)
    k = k.select("file_id", F.lit(0).alias("chunk_index"), F.row_number().over(Window.orderBy(F.desc("bm25"), "file_id")).alias("bm25_rank"))
    return D.rerank(k, _embedded(spark, sf_dir), QUERY_VECTOR).select("file_id", "dense_rank", six("similarity"))


@register("SELECT count(e.file_id) AS embedded, count(*) AS embeddable, count(e.file_id) >= 0.8 * count(*) AND count(*) > 0 AS available FROM chunks c LEFT JOIN embedded e USING (file_id, chunk_index) WHERE length(c.text) > 0", FILES_SQL, CHUNKS_SQL, EMBEDDED_SQL)
def dense_available(spark, sf_dir):
    """FLT19, STR9"""
    c = T.chunks(spark, sf_dir).where(F.length("text") > 0).join(_embedded(spark, sf_dir), ["file_id", "chunk_index"], "left")
    n = c.agg(F.count("vec_id").alias("embedded"), F.count("*").alias("embeddable"))
    return n.withColumn("available", D.available(F.col("embedded"), F.col("embeddable")))


@register("SELECT e.vec_id, f.path, c.chunk_id FROM embeddings e LEFT JOIN files f ON f.doc_id = e.vec_id * 3 LEFT JOIN chunks c ON c.file_id = f.file_id AND c.chunk_index = 0", FILES_SQL, CHUNKS_SQL)
def dense_enrich(spark, sf_dir):
    """JN12: vector hits with file and chunk where there are such."""
    f = T.files(spark, sf_dir)
    hits = T.embeddings(spark, sf_dir).join(f.select("file_id", (F.col("doc_id") / 3).alias("v")), F.col("vec_id") == F.col("v"), "left").select("vec_id", "file_id", F.lit(0).alias("chunk_index"))
    c = T.chunks(spark, sf_dir)
    return hits.join(f.select("file_id", "path"), "file_id", "left").join(c.select("file_id", "chunk_index", "chunk_id"), ["file_id", "chunk_index"], "left").select("vec_id", "path", "chunk_id")


# -- results ------------------------------------------------------------------

HITS_SQL = "hits AS (SELECT file_id, path, filename, extension, folder_path, modified_at, doc_id, round(size_bytes % 101 / 100.0, 6) AS score, CAST(doc_id % 7 + 1 AS INT) AS match_source FROM files)"
STEM_SQL = "regexp_replace(filename, '\\.[^./]*$', '')"


def _hits(spark, sf_dir) -> DataFrame:
    return T.files(spark, sf_dir).withColumn("score", F.round((F.col("size_bytes") % 101) / 100.0, 6)).withColumn("match_source", (F.col("doc_id") % 7 + 1).cast("int"))


# Numbers of one or two digits, and those that read as dates, are no part of a family's name.
FAMILY_SQL = "'/corpus|doc' || CASE WHEN regexp_full_match(n, '\\d{1,2}|[012]\\d(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])|20\\d{6}') THEN '' ELSE ' ' || n END"
NUMBERED_SQL = "numbered AS (SELECT *, regexp_extract(filename, 'doc_(\\d+)_v', 1) AS n FROM hits)"


@register(f"SELECT {FAMILY_SQL} AS family_key, list(file_id ORDER BY score DESC, file_id) AS files, max(modified_at) AS latest, max(score) AS score, count(*) AS n_files FROM numbered GROUP BY 1", FILES_SQL, HITS_SQL, NUMBERED_SQL)
def result_families(spark, sf_dir):
    """AGG7, FN18"""
    return R.families(_hits(spark, sf_dir).withColumn("folder_path", F.lit("/corpus")))


@register(f"SELECT file_id, versions, CAST(position AS INT) AS position, position = 1 AS is_latest FROM (SELECT file_id, count(*) OVER (PARTITION BY {FAMILY_SQL}) AS versions, row_number() OVER (PARTITION BY {FAMILY_SQL} ORDER BY score DESC, file_id) AS position FROM numbered) WHERE versions > 1", FILES_SQL, HITS_SQL, NUMBERED_SQL)
def family_positions(spark, sf_dir):
    """TOP10"""
    return R.family_positions(_hits(spark, sf_dir).withColumn("folder_path", F.lit("/corpus")))


FOLDERS_SQL = "SELECT lower(folder_path) AS folder_key, min(folder_path) AS folder, count(*) AS n_files, max(score) AS score, max(modified_at) AS latest FROM {} GROUP BY 1 ORDER BY score DESC, folder_key LIMIT 50"


@register(FOLDERS_SQL.format("hits"), FILES_SQL, HITS_SQL)
def folder_rollup(spark, sf_dir):
    """AGG8"""
    return R.folders(_hits(spark, sf_dir))


MERGED_SQL = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY folder_key ORDER BY n_files DESC, score DESC) AS n FROM (SELECT * FROM (" + FOLDERS_SQL.format("hits") + ") UNION ALL SELECT * FROM (" + FOLDERS_SQL.format("(SELECT * FROM hits WHERE (match_source & 4) <> 0)") + "))) WHERE n = 1 ORDER BY n_files DESC, folder_key LIMIT 10"


@register(MERGED_SQL, FILES_SQL, HITS_SQL)
def folder_merge(spark, sf_dir):
    """AGG9, SET1"""
    return _merged(_hits(spark, sf_dir))


def _merged(h: DataFrame) -> DataFrame:
    return R.merge_folders(R.folders(h), R.folders(h.where(F.col("match_source").bitwiseAND(F.lit(4)) != 0)))


@register(
    f"SELECT file_id, CASE WHEN e = '.pdf' THEN 'final_pdf' ELSE 'has_pdf' END AS note FROM (SELECT file_id, e, max(CAST(e = '.pdf' AS INT)) OVER w AS p, max(CAST(e IN ('.docx', '.doc', '.ppt', '.pptx') AS INT)) OVER w AS o FROM (SELECT *, lower(extension) AS e, doc_id // 16 AS stem FROM files) WINDOW w AS (PARTITION BY stem)) WHERE p = 1 AND o = 1 AND e IN ('.pdf', '.docx', '.doc', '.ppt', '.pptx')",
    FILES_SQL,
)
def format_siblings(spark, sf_dir):
    """AGG11"""
    f = T.files(spark, sf_dir)
    return R.format_siblings(f.withColumn("folder_path", F.lit("/x")).withColumn("filename", F.concat(F.expr("cast(doc_id div 16 as string)"), F.col("extension"))))


THRESHOLD_SQL = "SELECT file_id, score FROM hits, (SELECT avg(score) AS m FROM (SELECT score FROM hits ORDER BY score DESC, file_id LIMIT 3)) WHERE score >= 0.25 * m"


@register(THRESHOLD_SQL, FILES_SQL, HITS_SQL)
def content_threshold(spark, sf_dir):
    """FLT15"""
    return R.content_threshold(_hits(spark, sf_dir)).select("file_id", "score")


OPENED_SQL = "opened AS (SELECT lower(path) AS path_key, max(modified_at) AS last_opened FROM files WHERE doc_id % 5 = 0 GROUP BY 1)"
SECTIONS_SQL = """both_ AS (SELECT file_id, path, score, match_source, 0 AS list FROM hits UNION ALL SELECT file_id, path, score / 2, 1, 1 FROM (SELECT *, round(size_bytes % 101 / 100.0, 6) AS score FROM files WHERE doc_id % 50 = 1)),
names AS (SELECT *, row_number() OVER (ORDER BY list, score DESC, file_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY list, score DESC) AS n FROM both_ WHERE (match_source & 1) <> 0) WHERE n = 1),
rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY list, score DESC) AS n FROM both_ ANTI JOIN names USING (file_id)) WHERE n = 1),
seen AS (SELECT r.*, row_number() OVER (ORDER BY last_opened DESC, file_id) AS place FROM rest r JOIN opened o ON lower(r.path) = o.path_key),
leftover AS (SELECT * FROM rest ANTI JOIN seen USING (file_id) WHERE list = 0 AND (match_source & 2) <> 0),
bar AS (SELECT avg(score) AS m, count(*) AS n FROM (SELECT score FROM leftover ORDER BY score DESC, file_id LIMIT 3)),
content AS (SELECT l.*, row_number() OVER (ORDER BY score DESC, file_id) AS place FROM leftover l, bar WHERE bar.n < 3 OR score >= 0.25 * m),
placed AS (SELECT file_id, 'filename' AS section, CAST(place AS INT) AS place, score FROM names WHERE place <= 20
UNION ALL SELECT file_id, 'opened', CAST(place AS INT), score FROM seen WHERE place <= 5 UNION ALL SELECT file_id, 'content', CAST(place AS INT), score FROM content WHERE place <= 50)"""


def _placed(spark, sf_dir) -> DataFrame:
    f = T.files(spark, sf_dir)
    quick = f.where("doc_id % 50 = 1").select("file_id", "path", (F.round((F.col("size_bytes") % 101) / 100.0, 6) / 2).alias("score"))
    opened = f.where("doc_id % 5 = 0").groupBy(X.click_path(F.col("path")).alias("path_key")).agg(F.max("modified_at").alias("last_opened"))
    return R.sections(_hits(spark, sf_dir), quick, opened)


@register("SELECT * FROM placed", FILES_SQL, HITS_SQL, OPENED_SQL, SECTIONS_SQL)
def result_sections(spark, sf_dir):
    """JN15, SET1, SET2, SET5, TOP8, Q10, Q29"""
    return _placed(spark, sf_dir)


POSITIONS_SQL = "SELECT file_id, CAST(row_number() OVER (ORDER BY CASE section WHEN 'filename' THEN 0 WHEN 'opened' THEN 1 ELSE 2 END, place) - 1 AS INT) AS position FROM placed"


@register(POSITIONS_SQL, FILES_SQL, HITS_SQL, OPENED_SQL, SECTIONS_SQL)
def result_positions(spark, sf_dir):
    """TOP12"""
    return R.positions(_placed(spark, sf_dir)).select("file_id", "position")


@register("SELECT folder_path, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS distance FROM (SELECT folder_path, coalesce(list(DISTINCT extension) FILTER (doc_id % 3 = 0), []) AS a, coalesce(list(DISTINCT extension) FILTER (doc_id % 2 = 0), []) AS b FROM files GROUP BY folder_path)", FILES_SQL)
def jaccard(spark, sf_dir):
    """SET4"""
    g = T.files(spark, sf_dir).groupBy("folder_path").agg(F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.col("extension"))).alias("a"), F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("extension"))).alias("b"))
    return g.select("folder_path", F.round(R.jaccard_distance(F.col("a"), F.col("b")), 6).alias("distance"))


# -- clicks -------------------------------------------------------------------


def _clicks(spark, sf_dir) -> DataFrame:
    log = B.bounces(T.click_log(spark, sf_dir), 1800.0)
    return B.click_table(log.join(T.files(spark, sf_dir).select("doc_id", "path"), "doc_id"))


@register("SELECT event_id, is_bounce FROM bounced", FILES_SQL, CLICKS_SQL, BOUNCE_SQL)
def click_bounces(spark, sf_dir):
    """STR4 in batch, with half an hour instead of ten seconds: the test events are hours apart."""
    return B.bounces(T.click_log(spark, sf_dir), 1800.0).select("event_id", "is_bounce")


@register("SELECT * FROM clicks", FILES_SQL, CLICKS_SQL, BOUNCE_SQL)
def click_table(spark, sf_dir):
    """SNK10, STR5, Q25"""
    return _clicks(spark, sf_dir)


@register("SELECT path_key, round(CASE WHEN is_bounce THEN 0.0 ELSE least(1.0, least(1.0, 0.1 * click_count) * log2(position + 2.0)) END, 6) AS click_boost FROM clicks WHERE query = 'q7'", FILES_SQL, CLICKS_SQL, BOUNCE_SQL)
def click_boosts(spark, sf_dir):
    """FTS13, JN9, Q1"""
    return B.boosts(_clicks(spark, sf_dir), "q7").select("path_key", six("click_boost"))


@register("SELECT path_key, max(last_clicked) AS last_opened, CAST(sum(click_count) AS BIGINT) AS clicks FROM clicks WHERE NOT is_bounce GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", FILES_SQL, CLICKS_SQL, BOUNCE_SQL)
def recently_opened(spark, sf_dir):
    """AGG5, Q22"""
    return B.recently_opened(_clicks(spark, sf_dir), 25)


@register("SELECT count(*) AS searches, count(*) FILTER (event_id % 13 = 0) AS empty, CAST(sum(event_id % 500) // greatest(count(*), 1) AS BIGINT) AS mean_ms, count(*) FILTER (event_id % 3 = 0) AS fast, count(*) FILTER (event_id % 3 = 1) AS smart, count(*) FILTER (event_id % 3 = 2) AS deep, CASE WHEN max(n) < 1000 THEN '<1k' WHEN max(n) < 10000 THEN '1k-10k' WHEN max(n) < 100000 THEN '10k-100k' ELSE '100k+' END AS files_bucket FROM events, (SELECT count(*) AS n FROM documents) WHERE event_type = 'view'")
def telemetry(spark, sf_dir):
    """AGG19, Q18, A8"""
    e = T.table(spark, sf_dir, "events").where("event_type = 'view'").crossJoin(F.broadcast(T.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))))  # one row
    mode = F.get(F.array(F.lit("Fast"), F.lit("Smart"), F.lit("Deep")), (F.col("event_id") % 3).cast("int"))
    s = e.select(mode.alias("mode"), (F.col("event_id") % 500).alias("duration_ms"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(5).alias("results"), "n")
    return B.telemetry(s, F.col("n"))


@register("SELECT user_id, window_start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events) GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Extension of §2.11: tumbling windows over events."""
    e = T.table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.window("ts", "6 hours")).count().select("user_id", F.col("window.start").alias("window_start"), F.col("count").alias("n"))


# -- logs ---------------------------------------------------------------------


def _pct_sql(p: int) -> str:
    return f"list_sort(list(ms))[least(CAST(floor(count(*) * {p} / 100.0) AS BIGINT), count(*) - 1) + 1] AS p{p}"


def _events(spark, sf_dir) -> DataFrame:
    return L.parse_log(T.log_lines(spark, sf_dir))


@register("SELECT path, ext, size_bytes, ms, result FROM extracts", FILES_SQL, LOG_SQL)
def log_parse(spark, sf_dir):
    """SRC15, FN38"""
    return L.extracts(_events(spark, sf_dir))


@register(f"SELECT *, round(total_ms / greatest(sum(total_ms) OVER (), 1), 6) AS share FROM (SELECT ext, count(*) AS n, sum(ms) AS total_ms, max(ms) AS max_ms, {_pct_sql(50)}, {_pct_sql(95)} FROM extracts GROUP BY ext)", FILES_SQL, LOG_SQL)
def log_by_extension(spark, sf_dir):
    """AGG12-AGG14"""
    return L.by_extension(L.extracts(_events(spark, sf_dir))).withColumn("share", F.round("share", 6))


@register("SELECT ext, result, count(*) AS n FROM extracts GROUP BY 1, 2", FILES_SQL, LOG_SQL)
def log_results(spark, sf_dir):
    """AGG12"""
    return L.results(L.extracts(_events(spark, sf_dir)))


@register("SELECT ext, result, count(*) AS n FROM extracts WHERE starts_with(result, 'error') OR result = 'skip_cloud' GROUP BY 1, 2", FILES_SQL, LOG_SQL)
def log_failures(spark, sf_dir):
    """AGG17"""
    return L.failures(L.extracts(_events(spark, sf_dir)))


@register("SELECT CASE WHEN size_bytes < 102400 THEN '<100KB' WHEN size_bytes < 1048576 THEN '100KB-1MB' WHEN size_bytes < 10485760 THEN '1-10MB' ELSE '>10MB' END AS bucket, count(*) AS n, round(avg(ms), 6) AS mean_ms FROM (SELECT ms, size_bytes * 50 AS size_bytes FROM extracts) GROUP BY 1", FILES_SQL, LOG_SQL)
def log_size_buckets(spark, sf_dir):
    """AGG15"""
    return L.by_size(L.extracts(_events(spark, sf_dir)).withColumn("size_bytes", F.col("size_bytes") * 50)).withColumn("mean_ms", F.round("mean_ms", 6))


@register(f"SELECT ext, stage, count(*) AS n, sum(ms) AS total_ms, max(ms) AS max_ms, {_pct_sql(50)}, {_pct_sql(95)} FROM details GROUP BY 1, 2", FILES_SQL, LOG_SQL)
def log_stages(spark, sf_dir):
    """AGG13, AGG16"""
    return L.by_stage(L.details(_events(spark, sf_dir)))


@register("SELECT path, ext, size_bytes, ms FROM extracts ORDER BY ms DESC, path LIMIT 20", FILES_SQL, LOG_SQL)
def log_slowest(spark, sf_dir):
    """TOP11"""
    return L.slowest(L.extracts(_events(spark, sf_dir)))


@register("SELECT count(*) AS n, sum(ms) AS total_ms, round(count(*) / greatest(sum(ms) / 60000, 1e-9), 6) AS per_minute FROM extracts", FILES_SQL, LOG_SQL)
def log_throughput(spark, sf_dir):
    """AGG14"""
    return L.throughput(L.extracts(_events(spark, sf_dir))).withColumn("per_minute", F.round("per_minute", 6))


@register(
    """, per AS (SELECT ext, sum(ms) AS t, sum(ms) / greatest(sum(sum(ms)) OVER (), 1) AS share FROM extracts GROUP BY ext), top_ AS (SELECT * FROM per ORDER BY t DESC, ext LIMIT 5),
st AS (SELECT ext, stage, sum(ms) AS s, sum(sum(ms)) OVER (PARTITION BY ext) AS a, row_number() OVER (PARTITION BY ext ORDER BY sum(ms) DESC, stage DESC) AS n FROM details GROUP BY 1, 2)
SELECT ext, round(share, 6) AS share, stage, round(s / greatest(a, 1), 6) AS stage_share FROM top_ JOIN st USING (ext) WHERE n = 1 AND share > 0.05 AND s / greatest(a, 1) > 0.3""",
    FILES_SQL,
    LOG_SQL,
)
def log_bottlenecks(spark, sf_dir):
    """AGG18, with lower bars: the test log is even."""
    e = _events(spark, sf_dir)
    return L.bottlenecks(L.extracts(e), L.details(e), 5, 0.05, 0.3).select("ext", six("share"), "stage", six("stage_share"))


# -- scalar functions -----------------------------------------------------------


@register(
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0::DOUBLE, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round(n / 1073741824.0::DOUBLE, 1)) END AS shown,
  strftime(modified_at, '%Y-%m-%d') AS day, upper(CASE WHEN extension IN ('.docx') THEN 'DOC' WHEN extension = '.xlsx' THEN 'XLS' ELSE left(ltrim(extension, '.'), 3) END) AS label,
  length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) < 0.2 AND length(text) >= 50 AS garbled
FROM (SELECT *, size_bytes * size_bytes AS n FROM files)""",
    FILES_SQL,
)
def scalar_formats(spark, sf_dir):
    """FN22-FN24, FN36"""
    f = T.files(spark, sf_dir, True)
    return f.select("doc_id", X.show_size(F.col("size_bytes") * F.col("size_bytes")).alias("shown"), X.show_date(F.col("modified_at").cast("string")).alias("day"), X.abbreviate(F.col("extension")).alias("label"), X.likely_garbled(F.col("text")).alias("garbled"))


@register(
    """SELECT doc_id, CASE WHEN p = 0 THEN CASE WHEN n <= 200 THEN text ELSE left(text, 200) || '...' END
  ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < n THEN '...' ELSE '' END END AS snippet
FROM (SELECT *, greatest(0, p - 101) AS s, least(n, p - 1 + 4 + 100, greatest(0, p - 101) + 200) AS e FROM (SELECT doc_id, text, length(text) AS n, strpos(lower(text), 'erin') AS p FROM files))""",
    FILES_SQL,
)
def snippets(spark, sf_dir):
    """FN16 with a literal term ('erin' is its own stem)."""
    return T.files(spark, sf_dir, True).select("doc_id", X.snippet(F.col("text"), ["erin"]).alias("snippet"))


@register("SELECT doc_id, regexp_replace(text, 'erin', '<mark>\\0</mark>', 'gi') AS marked FROM documents")
def highlights(spark, sf_dir):
    """FN17"""
    return T.table(spark, sf_dir, "documents").select("doc_id", X.highlight(F.col("text"), ["erin"]).alias("marked"))


def _decoded_sql(c: str) -> str:
    """The references that the pages hold, with and without their semicolon; the ampersand last, so none is decoded twice."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("nbsp", " "), ("lt", "<"), ("gt", ">")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


@register(
    f"""SELECT page_id, trim(regexp_replace({_decoded_sql("regexp_replace(regexp_replace(html, '(?is)<(?:script)[^>]*>.*?</script>|<(?:style)[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM pages"""
)
def html_text(spark, sf_dir):
    """SRC4, FN30 on every page; references that the tables don't hold are tested against html.unescape."""
    return T.table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@register("SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''') AS text FROM pages")
def xml_unescape(spark, sf_dir):
    """FN30"""
    return T.table(spark, sf_dir, "pages").select("page_id", X.xml_unescape(F.col("html")).alias("text"))


@register("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS squares FROM embeddings")
def vector_units(spark, sf_dir):
    """FN26, FN28"""
    u = X.unit(F.col("embedding"))
    d = X.dot(F.col("embedding"), F.col("embedding"))
    return T.embeddings(spark, sf_dir).select("vec_id", F.round(X.dot(u, u) * d, 6).alias("squares"))


@register("SELECT doc_id, bround AS score FROM (SELECT doc_id, round_even(CAST(n_chars AS DOUBLE) / 7, 4) AS bround FROM documents)")
def score_rounding(spark, sf_dir):
    """FN32"""
    return T.table(spark, sf_dir, "documents").select("doc_id", F.bround(F.col("n_chars") / 7, 4).alias("score"))
