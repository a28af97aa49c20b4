"""Registered queries over every row of their tables."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.plans import readers  # noqa: F401  (registers its queries)
from lumenspan.plans.catalogue import ORACLES, QUERIES
from lumenspan.sources import corpus as T

ALL_HITS = ["html_text", "result_families", "family_positions", "folder_rollup", "folder_merge", "content_threshold", "result_sections", "result_positions"]


@pytest.mark.parametrize("name", ALL_HITS)
def test_all_hits(spark, sf, name):
    duckdb = pytest.importorskip("duckdb").connect()
    for table in ("documents", "pages"):
        duckdb.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = QUERIES[name](spark, sf)
    found = duckdb.execute(ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_every_file_is_met(spark, sf):
    files = T.files(spark, sf).count()
    assert QUERIES["result_families"](spark, sf).agg(F.sum("n_files")).first()[0] == files
    assert QUERIES["badges"](spark, sf).count() == files


def plain_text(markup):
    if markup is None:
        return None
    bare = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", markup))
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", html.unescape(bare)).strip(" ")


def test_html_text_of_every_page(spark, sf, tmp_path):
    pages = ["<p>a&#233;b &#x20AC;&lt;i&gt; &apos;q&apos;</p>", "cut off &amp<", "x &quot y &ampz &quo", "&#0;&#128;&#xD800;&#1114112;", "&amp;lt; &amp;#65;", "&notit; &hellip;&NotEqualTilde;", "<script>&lt;</script>a<STYLE>b</style>\n c", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert got == {i: plain_text(p) for i, p in enumerate(pages)} and got[0] == "aéb €<i> 'q'"
    rows = T.table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {r["page_id"]: plain_text(r["html"]) for r in rows} and {28, 43, 113} <= set(got)


@pytest.fixture
def long_texts(spark, tmp_path):
    """Documents of which some are longer than 500 chunks; what is looked for stands behind those, and in few others."""
    filler = [f"w{i} plain words of no account" for i in range(40_000)]
    texts = ["\n".join(filler[:25_000] + [f"erin thing{i}"] * (i + 1)) for i in range(3)] + ["erin and things", "a short text here", None, "", "no words", "erin too", "the end of all"]
    texts += ["\n".join(filler)[k : k + 1500] for k in range(0, 60_000, 1500)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def same_as_sql(name, spark, home):
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW documents AS SELECT * FROM '{home}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, home)
    found = duckdb.execute(ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    return [dict(zip(got.columns, r, strict=True)) for r in rows]


def test_search_meets_the_ends_of_long_texts(spark, long_texts):
    found = same_as_sql("fts_bm25_and_prefix", spark, long_texts)
    assert len(found) == 4
    chunks = T.chunks(spark, long_texts, None)
    late = {r["chunk_id"] for r in chunks.where("chunk_index >= 500 and text like '%erin thing%'").collect()}
    assert len(late) == 3 and {r["chunk_id"] for r in found} > late


def add_large(spark, home):
    """A text of over 10 MB beside the others."""
    text = "z" * (11 << 20)
    spark.createDataFrame([(50, text, "en", "src0", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{home}/documents.parquet")


def test_changed_files_are_chunked_to_their_ends(spark, long_texts):
    add_large(spark, long_texts)
    found = {r["doc_id"]: r["chunks"] for r in same_as_sql("stream_changes", spark, long_texts)}
    assert found[0] > 500 and found[1] > 500 and found[50] == (11 << 20) // 1000 + 1


def test_new_files_are_chunked_to_their_ends(spark, long_texts):
    add_large(spark, long_texts)
    found = same_as_sql("stream_ingest", spark, long_texts)
    assert len(found) == 1 and found[0]["chunks"] > (11 << 20) // 1000 + 2 * 500 and found[0]["chars"] > (11 << 20) + 2 * 500_000
