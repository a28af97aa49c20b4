"""Registered queries of the search language: tokenizers, stemmers, query parser, names, and searches over stemmed terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X
from ..functions import words
from ..functions.query import Any, Atom
from ..functions.stem import STEP2, STEP3, STEP4, porter1, porter2
from ..operators import catalogue as C
from ..operators import search as S
from ..sources import corpus as T
from ..sources import scan
from ..sources.corpus import CHUNKS_SQL, FILES_SQL
from .catalogue import BEST_SQL, BOOST_SQL, RECENCY, bm25_ctes, index, now, register, six

# -- Porter's first stemmer in SQL ----------------------------------------------


def _shape(e: str) -> str:
    """A word's consonants as C and vowels as V; a y is a vowel behind a consonant."""
    e = f"regexp_replace(regexp_replace({e}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    e = f"regexp_replace({e}, '^y', 'C')"
    for _ in range(2):
        e = f"replace(replace({e}, 'Cy', 'CV'), 'Vy', 'VC')"
    return e


def _measure(e: str) -> str:
    return f"len(regexp_extract_all({_shape(e)}, 'V+C+'))"


def _cut(e: str, n: int) -> str:
    return f"left({e}, length({e}) - {n})"


def _short(e: str) -> str:
    return f"(ends_with({_shape(e)}, 'CVC') AND right({e}, 1) NOT IN ('w', 'x', 'y'))"


def _suffixes(name: str, source: str, table: list[tuple[str, str]], apply: str) -> list[str]:
    """Two steps: the longest suffix of ``table`` that a word ends in, and ``apply`` of its stem {s}, suffix {e} and replacement {r}."""
    order = sorted(table, key=lambda x: -len(x[0]))
    find = " ".join(f"WHEN ends_with(w, '{e}') THEN '{e}'" for e, _ in order)
    new = " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in order)
    found = f"{name}f AS (SELECT t, w, CASE {find} END AS e FROM {source})"
    stem = "left(w, length(w) - length(e))"
    return [found, f"{name} AS (SELECT t, CASE WHEN e IS NULL THEN w WHEN {apply.format(s=stem, m=_measure(stem))} THEN {stem} || CASE e {new} END ELSE w END AS w FROM {name}f)"]


def stem_ctes(source: str) -> str:
    """``stems`` (t, s): the stem of each of ``source``'s distinct terms t."""
    vowel = lambda e: f"contains({_shape(e)}, 'V')"
    ed, ing, eed = _cut("w", 2), _cut("w", 3), _cut("w", 3)
    double = f"(length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND right({_shape('w')}, 1) = 'C')"
    steps = [
        f"p0 AS (SELECT DISTINCT t, t AS w FROM {source})",
        f"p1 AS (SELECT t, CASE WHEN ends_with(w, 'sses') THEN {_cut('w', 2)} WHEN ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut('w', 1)} ELSE w END AS w FROM p0 WHERE length(t) > 2 AND regexp_full_match(t, '[a-z]+'))",
        f"p2 AS (SELECT t, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(eed)} > 0 THEN {_cut('w', 1)} ELSE w END WHEN ends_with(w, 'ed') AND {vowel(ed)} THEN {ed} WHEN ends_with(w, 'ing') AND {vowel(ing)} THEN {ing} ELSE w END AS w, NOT ends_with(w, 'eed') AND (ends_with(w, 'ed') AND {vowel(ed)} OR ends_with(w, 'ing') AND {vowel(ing)}) AS off FROM p1)",
        f"p3 AS (SELECT t, CASE WHEN NOT off THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' WHEN {double} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_cut('w', 1)} WHEN {_measure('w')} = 1 AND {_short('w')} THEN w || 'e' ELSE w END AS w FROM p2)",
        f"p4 AS (SELECT t, CASE WHEN ends_with(w, 'y') AND {vowel(_cut('w', 1))} THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM p3)",
        *_suffixes("p5", "p4", STEP2, "{m} > 0"),
        *_suffixes("p6", "p5", STEP3, "{m} > 0"),
        *_suffixes("p7", "p6", [(e, "") for e in STEP4], "{m} > 1 AND (e <> 'ion' OR right({s}, 1) IN ('s', 't'))"),
        f"p8 AS (SELECT t, CASE WHEN ends_with(w, 'e') AND ({_measure(_cut('w', 1))} > 1 OR {_measure(_cut('w', 1))} = 1 AND NOT {_short(_cut('w', 1))}) THEN {_cut('w', 1)} ELSE w END AS w FROM p7)",
        f"p9 AS (SELECT t, CASE WHEN ends_with(w, 'll') AND {_measure('w')} > 1 THEN {_cut('w', 1)} ELSE w END AS w FROM p8)",
        "stems AS (SELECT p0.t, coalesce(p9.w, p0.t) AS s FROM p0 LEFT JOIN p9 USING (t))",
    ]
    return ",\n".join(steps)


def folded_sql(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


DOC_TERMS_SQL = f"doc_terms AS (SELECT doc_id, unnest({folded_sql('text')}) AS t FROM documents)"


@register("SELECT d.doc_id, coalesce(x.terms, '') AS terms, coalesce(x.n_terms, 0) AS n_terms FROM documents d LEFT JOIN (SELECT doc_id, string_agg(DISTINCT s, ' ' ORDER BY s) AS terms, count(DISTINCT s) AS n_terms FROM doc_terms JOIN stems USING (t) GROUP BY doc_id) x USING (doc_id)", DOC_TERMS_SQL, stem_ctes("doc_terms"))
def porter_terms(spark, sf_dir):
    """FTS1: the distinct stemmed terms of each document, without diacritics."""
    found = T.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(X.terms(F.col("text")))).alias("t"))
    return found.select("doc_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms"))


# Chunks' terms in order, for the SQL of searches over stems.
STEMMED_SQL = f"""tokens AS (SELECT chunk_id, c, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS t FROM (
  SELECT chunk_id, 'a' AS c, {folded_sql('text')} AS l FROM chunks UNION ALL SELECT chunk_id, 'b', {folded_sql('filename')} FROM chunks UNION ALL SELECT chunk_id, 'c', {folded_sql('folder_path')} FROM chunks)),
{stem_ctes('tokens')},
lists AS (SELECT chunk_id, list(s ORDER BY pos) FILTER (c = 'a') AS a, list(s ORDER BY pos) FILTER (c = 'b') AS b, list(s ORDER BY pos) FILTER (c = 'c') AS c FROM tokens JOIN stems USING (t) GROUP BY chunk_id),
stemmed AS (SELECT chunks.*, coalesce(a, []) AS a, coalesce(b, []) AS b, coalesce(c, []) AS c FROM chunks LEFT JOIN lists USING (chunk_id))"""


def stemmed_ctes(found: list[Atom], where: str) -> str:
    """``scored`` as bm25_ctes makes it, over stems; the atoms' own words must be stems."""
    made = bm25_ctes(found, where)
    return f"{STEMMED_SQL},\nsplit_ AS (SELECT * FROM stemmed),\n{made[made.index('counted AS') :]}"


@register("SELECT file_id, path, chunk_id, match_source, round(score, 6) AS score FROM best WHERE n = 1 ORDER BY score DESC, file_id LIMIT 20", FILES_SQL, CHUNKS_SQL, stemmed_ctes([Atom("erin", True), Atom("pour", True)], "{h0} OR {h1}"), BEST_SQL)
def fts_search_words(spark, sf_dir):
    """API5, JN1, JN3, FN7: a query in words, parsed, stemmed and boosted, by the stored index."""
    out = S.search(index(spark, sf_dir, "porter"), T.files(spark, sf_dir), "the erin pour", now())
    return out.select("file_id", "path", "chunk_id", "match_source", six("score"))


STEM_QUERY = Any((Atom("things of"), Atom("eringly", True)))


@register(
    "SELECT file_id, chunk_id, round(bm25, 6) AS bm25, match_source FROM scored ORDER BY bm25 DESC, chunk_id LIMIT 60",
    FILES_SQL,
    CHUNKS_SQL,
    stemmed_ctes([Atom(f"{porter1('things')} of"), Atom(porter1("eringly"), True)], "{h0} OR {h1}"),
)
def fts_stemmed_phrase(spark, sf_dir):
    """FTS1-FTS3: a phrase and a prefix whose words are stemmed as the texts are."""
    best = index(spark, sf_dir, "porter").top(STEM_QUERY, S.most_candidates(S.Options(20)), 6)
    return best.select("file_id", "chunk_id", "bm25", "match_source")


@register(
    f"""SELECT file_id, path, chunk_id, match_source, round(score, 6) AS score FROM (SELECT * FROM best WHERE n = 1 ORDER BY score DESC, file_id LIMIT 20) JOIN files f USING (file_id, path) WHERE lower(f.extension) IN ('.pdf', '.docx', '.md')""",
    FILES_SQL,
    CHUNKS_SQL,
    bm25_ctes([Atom("erin"), Atom("pour", True)], "{h0} OR {h1}"),
    BEST_SQL,
)
def fts_extensions_after(spark, sf_dir):
    """FLT11, Q2: extensions looked at after the best files are taken."""
    options = S.Options(20, 1, (".PDF", ".docx", ".md"), "post", "simple")
    best = index(spark, sf_dir).top(Any((Atom("erin"), Atom("pour", True))), S.most_candidates(options))
    out = S.best_per_file(S.score_hits(best, T.files(spark, sf_dir), [], now()), options)
    return out.select("file_id", "path", "chunk_id", "match_source", six("score"))


@register(
    f"SELECT file_id, round(bm25 * {RECENCY} * {BOOST_SQL}, 6) AS score FROM (SELECT * FROM scored ORDER BY bm25 DESC, chunk_id LIMIT 60) JOIN files USING (file_id) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY bm25 DESC, chunk_id) = 1 AND extension = '.md' ORDER BY score DESC, file_id LIMIT 20",
    FILES_SQL,
    CHUNKS_SQL,
    bm25_ctes([Atom("erin"), Atom("pour", True)], "{h0} OR {h1}"),
)
def fts_extensions_before(spark, sf_dir):
    """FLT11, Q2: extensions looked at before the best files are taken."""
    options = S.Options(20, 1, (".md",), "pre", "simple")
    best = index(spark, sf_dir).top(Any((Atom("erin"), Atom("pour", True))), S.most_candidates(options))
    return S.best_per_file(S.score_hits(best, T.files(spark, sf_dir), [], now()), options).select("file_id", six("score"))


# -- words of a query ---------------------------------------------------------------

STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(words.STOP_WORDS)) + "]"
PARTICLE_SQL = "regexp_replace({}, '^(.+?)(" + "|".join(sorted(words.KOREAN_PARTICLES, key=len, reverse=True)) + ")$', '\\1')"
KOREAN_TAILS = ["계약서를 검토", "회사에서 보고서까지", "the 은 는", "e-mail 예산과"]


@register(
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(q, '[ ,.\\-_]'), lambda x: x <> '' AND NOT list_contains({STOPS_SQL}, lower(x))), lambda x: CASE WHEN regexp_matches(x, '[가-힣ㄱ-ㆎ]') THEN {PARTICLE_SQL.format('x')} ELSE x END), lambda x: NOT list_contains({STOPS_SQL}, lower(x))), ' ') AS kept
FROM (SELECT doc_id, coalesce(text, '') || ' ' || ({KOREAN_TAILS!r})[doc_id % {len(KOREAN_TAILS)} + 1] AS q FROM documents)"""
)
def stop_words(spark, sf_dir):
    """FN4-FN6: whole texts with Korean words, without any stop word and without particles."""
    tail = F.get(F.array(*map(F.lit, KOREAN_TAILS)), (F.col("doc_id") % len(KOREAN_TAILS)).cast("int"))
    q = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), tail)
    return T.table(spark, sf_dir, "documents").select("doc_id", X.remove_stop_words(q).alias("kept"))


CJK_TEXTS = ["年度報告 {} 書", "plan {} 보고서", "漢字テスト漢 {} 予算書", "none {}"]
CJK_SPLIT = ["年度 度報 報告 {} 書", "plan {} 보고서", "漢字テスト漢 {} 予算 算書", "none {}"]
CJK_PAIRS = ["年度 度報 報告", "", "漢字 予算 算書", ""]
CJK_KIND = [(True, False), (False, True), (True, False), (False, False)]


@register(
    f"SELECT doc_id, replace(({CJK_SPLIT!r})[k], '{{}}', CAST(doc_id AS VARCHAR)) AS split, ({CJK_PAIRS!r})[k] AS pairs, ({[a for a, _ in CJK_KIND]!r})[k] AS is_cjk, ({[b for _, b in CJK_KIND]!r})[k] AS is_korean FROM (SELECT doc_id, CAST(doc_id % 4 + 1 AS INT) AS k FROM documents)"
)
def cjk_bigrams(spark, sf_dir):
    """FTS9, FN13-FN15: runs of ideographs in overlapping pairs."""
    t = F.replace(F.get(F.array(*map(F.lit, CJK_TEXTS)), (F.col("doc_id") % 4).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    return T.table(spark, sf_dir, "documents").select("doc_id", X.bigram_split(t).alias("split"), F.array_join(X.bigrams(t), " ").alias("pairs"), X.is_cjk(t).alias("is_cjk"), X.is_korean(t).alias("is_korean"))


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) x({names})"


WORDS_SQL = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"


def _document_words(spark, sf_dir) -> DataFrame:
    """The distinct words of all documents, in the letters a to z."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return T.table(spark, sf_dir, "documents").select(found.alias("w")).distinct()


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _more_sql() -> str:
    """What the expansion table adds to a word, then what is left behind the first prefix that fits."""
    table = "CASE w " + " ".join(f"WHEN '{k}' THEN {_list_sql([e for e in v if not e.startswith('.')])}::VARCHAR[]" for k, v in words.EXPANSIONS.items() if k.isascii()) + " ELSE []::VARCHAR[] END"
    prefix = f"list_filter({_list_sql(words.COMPOUND_PREFIXES)}, lambda p: length(w) >= greatest(4, length(p) + 3) AND starts_with(w, p))[1]"
    return f"list_concat({table}, CASE WHEN {prefix} IS NULL THEN []::VARCHAR[] ELSE [substr(w, length({prefix}) + 1)] END)"


@register(
    f"""SELECT w AS query, CASE WHEN list_contains({STOPS_SQL}, w) THEN NULL WHEN len(more) = 0 THEN own WHEN len(more) = 1 THEN '(' || own || ' OR ' || more[1] || ')' ELSE '(' || own || ' OR (' || array_to_string(more, ' OR ') || '))' END AS expression
FROM (SELECT w, '"' || w || '"' || CASE WHEN length(w) >= 4 OR list_contains({_list_sql(sorted(words.ACRONYMS))}, upper(w)) THEN '*' ELSE '' END AS own, list_transform({_more_sql()}, lambda x: '"' || x || '"*') AS more FROM words)""",
    WORDS_SQL,
)
def query_expressions(spark, sf_dir):
    """FN7, FN9-FN11, SET3, FTS3: the expression that every word of the documents becomes as a query."""

    @F.pandas_udf("string")
    def expression(w):
        return w.map(lambda q: str(e) if (e := Q.parse(q)) is not None else None)

    return _document_words(spark, sf_dir).select(F.col("w").alias("query"), expression("w").alias("expression"))


@register("SELECT t AS word, s AS stem FROM stems", WORDS_SQL, "found AS (SELECT w AS t FROM words)", stem_ctes("found"))
def stem_words(spark, sf_dir):
    """FTS1: the index's stem of every word of the documents."""

    @F.pandas_udf("string")
    def stem(w):
        return w.map(porter1)

    return _document_words(spark, sf_dir).select(F.col("w").alias("word"), stem("w").alias("stem"))


@register("SELECT doc_id, CAST(n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS BIGINT) AS bytes FROM documents")
def size_options(spark, sf_dir):
    """FN35: sizes as they are typed, of every document, in bytes."""

    @F.pandas_udf("long")
    def size(text):
        return text.map(scan.parse_size)

    unit = F.get(F.array(F.lit(""), F.lit("KB"), F.lit(" mb"), F.lit("GB")), (F.col("doc_id") % 4).cast("int"))
    return T.table(spark, sf_dir, "documents").select("doc_id", size(F.concat(F.col("n_chars").cast("string"), unit)).alias("bytes"))


# -- names and paths -------------------------------------------------------------


@register(
    "SELECT file_id, lower(path) AS path_key, '.docx' AS normal, extension AS ext, regexp_replace(filename, '\\.[^./]*$', '') AS stem, folder_path AS folder, doc_id % 3 = 0 AS copied FROM files",
    FILES_SQL,
)
def path_parts(spark, sf_dir):
    """FN3, FN19, FN21"""
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat(X.file_stem(F.col("filename")), F.lit(" (2)"), F.col("extension"))).otherwise(F.col("filename"))
    mixed = F.when(F.col("doc_id") % 2 == 0, "DOCX").otherwise(" .Docx")
    f = T.files(spark, sf_dir)
    return f.select("file_id", X.click_path(F.concat(F.upper("path"), F.lit("//"))).alias("path_key"), X.normal_extension(mixed).alias("normal"), X.extension(F.upper("filename")).alias("ext"), X.file_stem(F.col("filename")).alias("stem"), X.dirname(F.col("path")).alias("folder"), X.is_copy_name(shown).alias("copied"))


@register("SELECT file_id FROM files WHERE contains(filename, '_1') AND contains(path, '_v')", FILES_SQL)
def like_literals(spark, sf_dir):
    """FN2: wildcards in a user's words stand for themselves."""
    return T.files(spark, sf_dir).where(F.col("filename").like(f"%{X.like_escape('_1')}%") & F.col("path").like(f"%{X.like_escape('_v')}%")).select("file_id")


@register("SELECT wanted, count(*) AS n FROM (SELECT unnest([-5, 0, 7, 200, 9999]) AS wanted), (SELECT row_number() OVER () AS r FROM files) WHERE r <= least(200, greatest(1, wanted)) GROUP BY wanted", FILES_SQL)
def listing_limits(spark, sf_dir):
    """FN33: limits are kept between 1 and 200."""
    f = T.files(spark, sf_dir)
    out: DataFrame | None = None
    for wanted in (-5, 0, 7, 200, 9999):
        one = C.listing(f, None, None, wanted).agg(F.count("*").alias("n")).select(F.lit(wanted).alias("wanted"), "n")
        out = one if out is None else out.unionByName(one)
    return out
