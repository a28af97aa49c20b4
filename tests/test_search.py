import datetime

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.functions.query import All, Any, Atom, parse
from lumenspan.operators import dense as D
from lumenspan.operators import feedback as B
from lumenspan.operators import index as I
from lumenspan.operators import results as R
from lumenspan.operators import search as S
from lumenspan.plans.api import Engine

CORPUS = [
    ("budget-2024-report.docx", "budget report for fiscal year 2024 quarterly analysis"),
    ("project-plan-q1.docx", "project plan document q1 milestones deliverables"),
    ("meeting-notes-jan.txt", "meeting notes january team sync budget discussion"),
    ("annual-report-2023.pdf", "annual report 2023 revenue growth key achievements"),
    ("roadmap-vision.md", "product roadmap vision long-term strategic goals"),
    ("budget-proposal.xlsx", "budget proposal draft spending estimates proposal"),
    ("readme.md", "readme overview installation quickstart guide"),
    ("explanation.txt", "explanation details context reasoning background"),
    ("finance-summary.docx", "finance summary expenses revenue profit margin"),
    ("plan-template.docx", "plan template sections checklist empty fields"),
]
NOW = datetime.datetime(2024, 7, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(f"f{i}", n, f"/corpus/{n}", "." + n.rpartition(".")[2], "/corpus", NOW - datetime.timedelta(days=i), 1000, "SUCCESS", None, t) for i, (n, t) in enumerate(CORPUS)]
    files = spark.createDataFrame(rows, "file_id string, filename string, path string, extension string, folder_path string, modified_at timestamp_ntz, size_bytes long, extract_status string, error_code string, text string")
    chunks = files.select("file_id", "filename", "folder_path", "text", F.lit(0).alias("chunk_index")).withColumn("chunk_id", X.chunk_id(F.col("file_id"), F.col("chunk_index")))
    return files.drop("text"), chunks


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("report", ["annual-report-2023.pdf", "budget-2024-report.docx"]),
        ("budget 2024", ["budget-2024-report.docx", "budget-proposal.xlsx", "meeting-notes-jan.txt"]),
        ("plan", ["project-plan-q1.docx", "plan-template.docx"]),
    ],
)
def test_golden_ranking(golden, query, expected):
    files, chunks = golden
    got = S.search(chunks, files, query, now(), S.Options(top=10, per_file=4)).collect()
    assert [r["filename"] for r in got] == expected


@pytest.mark.parametrize("query", ["budgets", "expense", "milestone", "proposals"])
def test_stemming(golden, query):
    files, chunks = golden
    assert S.search(chunks, files, query, now()).count() >= 1


def test_nothing(golden):
    files, chunks = golden
    assert S.search(chunks, files, "the of", now()).count() == 0
    assert S.search(chunks.limit(0), files, "budget", now()).count() == 0


@pytest.fixture(scope="module")
def built(golden, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    I.build(golden[1], path)
    return path


@pytest.mark.parametrize("query", [parse("budget report"), All((Atom("budget"), Atom("rep", True))), Atom("fiscal year"), Any((Atom("plan q1"), Atom("plan", True)))])
def test_index_agrees_with_scan(spark, golden, built, query):
    _, chunks = golden
    a = {r["chunk_id"]: round(r["bm25"], 9) for r in S.bm25(chunks, query).collect()}
    b = {r["chunk_id"]: round(r["bm25"], 9) for r in I.Index(spark, built).search(query).collect()}
    assert a == b and a


def test_clicks_boost(spark, golden):
    files, chunks = golden
    clicks = spark.createDataFrame([(1, "plan", "/CORPUS/plan-template.docx", 0), (2, "plan", "/corpus/Plan-template.docx", 3), (3, "plan", "/corpus/project-plan-q1.docx", 9)], "event_id long, query string, path string, position int").withColumn("ts", now()).withColumn("is_bounce", F.col("event_id") == 3)
    table = B.click_table(clicks)
    boost = {r["path_key"]: r["click_boost"] for r in B.boosts(table, "plan").collect()}
    assert boost == {"/corpus/plan-template.docx": pytest.approx(0.2), "/corpus/project-plan-q1.docx": 0.0}
    first = S.search(chunks, files, "plan", now(), boosts=B.boosts(table, "plan")).first()
    assert first["filename"] == "plan-template.docx"
    assert [r["path_key"] for r in B.recently_opened(table).collect()] == ["/corpus/plan-template.docx"]


def test_fusion(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "file_id string, rank int, score double")
    k, d = ranked([("f1", 1, 3.0), ("f2", 2, 2.0), ("f3", 3, 1.0)]), ranked([("f4", 1, 0.9), ("f5", 2, 0.8), ("f6", 3, 0.7)])
    assert D.fuse(k, d).count() == 6 and D.fuse(k, d, 3).count() == 3
    shared = D.fuse(k, ranked([("f3", 1, 0.9)])).first()
    assert shared["file_id"] == "f3"
    assert {r["dense_score"] for r in D.fuse(k, d.limit(0)).collect()} == {0.0}


def test_dense(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = D.similar(e, [1.0, 0.0]).collect()
    assert [r["vec_id"] for r in got] == [0, 3, 4] and got[0]["similarity"] > 0.9


def test_families_and_badges(spark):
    rows = [("a", "/d/report_v1.pdf"), ("b", "/d/report_v2.pdf"), ("c", "/d/plan.docx"), ("d", "/d/plan.pdf"), ("e", "/x/notes copy.txt")]
    f = spark.createDataFrame([(i, p) for i, p in rows], "file_id string, path string").withColumn("filename", X.filename(F.col("path"))).withColumn("folder_path", X.dirname(F.col("path"))).withColumn("extension", X.extension(F.col("filename"))).withColumn("modified_at", now() - F.expr("interval 3 days")).withColumn("score", F.when(F.col("file_id") == "b", 2.0).otherwise(1.0))
    fam = {tuple(r["files"]) for r in R.families(f).collect()}
    assert ("b", "a") in fam and ("c", "d") in fam
    notes = {r["file_id"]: [(n["priority"], n["code"]) for n in r["notes"]] for r in R.badges(f, now(), versions=R.family_positions(f)).collect()}
    assert notes["b"] == [(2, "latest"), (7, "modified_this_week"), (8, "related_in_folder")]
    assert notes["a"][0] == (2, "not_latest")
    assert notes["c"][0] == (1, "has_pdf") and notes["d"][0] == (1, "final_pdf")
    assert notes["e"] == [(7, "modified_this_week"), (10, "copy")]


def test_sections_caps(spark):
    hybrid = spark.createDataFrame([(f"h{i:02}", f"/p/h{i}", 1.0 - i / 100, 1 if i < 25 else 2) for i in range(40)], "file_id string, path string, score double, match_source int")
    quick = spark.createDataFrame([], "file_id string, path string, score double")
    opened = spark.createDataFrame([("/p/h30", NOW)], "path_key string, last_opened timestamp_ntz")
    got = R.sections(hybrid, quick, opened).collect()
    names = [r for r in got if r["section"] == "filename"]
    assert len(names) == 20 and [r["file_id"] for r in got if r["section"] == "opened"] == ["h30"]
    assert {r["file_id"] for r in got} & {f"h{i}" for i in range(20, 25)} == set()
    assert len(R.sections(hybrid, quick, opened, keep_overflow=True).collect()) == 20 + 1 + 14


def test_engine(golden):
    files, chunks = golden
    e = Engine(files, chunks, now())
    got = e.search_files("budget", 5)
    assert set(got) == {"query", "mode", "count", "items", "stats"} and got["count"] == 3
    assert set(got["items"][0]) == {"fileId", "filename", "path", "extension", "score", "matchSnippet", "matchSource", "modifiedAt"}
    assert "budget" in got["items"][0]["matchSnippet"] and "FileName" in got["items"][0]["matchSource"]
    assert "error" in e.search_files("  ") and "error" in e.get_file_content("") and "error" in e.get_file_content("none")
    assert e.get_file_content("f0")["content"].startswith("budget report") and e.get_file_content("f0")["truncated"] is False
    assert e.list_indexed_files("/corpus", "docx")["count"] == 4
    s = e.get_pipeline_status()
    assert s["totalFiles"] == 10 and s["totalChunks"] == 10 and s["embeddingComplete"] is False
