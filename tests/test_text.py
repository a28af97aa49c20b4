import datetime

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import text as X
from lumenspan.operators import catalogue as C
from lumenspan.operators.chunks import chunk_files, chunk_text


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"x": 1}
    return spark.createDataFrame([row]).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("report_v1.pdf", "report"), ("contract_final.docx", "contract"), ("Copy of plan 20240115.xlsx", "plan"), ("★ notes (2).txt", "notes"), ("예산 최종.hwp", "예산"), ("data_240131_rev2.csv", "data")],
)
def test_family_name(spark, name, expected):
    assert one(spark, X.family_name(F.col("n")), n=name) == expected


def test_snippet(spark):
    long = "x" * 300 + " budget plan " + "y" * 300
    got = one(spark, X.snippet(F.col("t"), ["budget"]), t=long)
    assert "budget" in got and got.startswith("...") and got.endswith("...") and len(got) <= 206
    assert one(spark, X.snippet(F.col("t"), ["documents"]), t="all documentation here") == "all documentation here"
    assert one(spark, X.snippet(F.col("t"), []), t="a" * 250) == "a" * 200 + "..."
    assert one(spark, X.snippet(F.col("t"), ["q"]), t="") == ""


def test_highlight(spark):
    assert one(spark, X.highlight(F.col("t"), ["Plan"]), t="the plan: PLAN") == "the <mark>plan</mark>: <mark>PLAN</mark>"


def test_word_boundary(spark):
    match = lambda n, t: one(spark, X.word_boundary_match(F.col("n"), t), n=n)
    assert match("project-plan.docx", "plan") and not match("explanation.pdf", "plan") and match("예산plan.pdf", "plan")


def test_bigrams(spark):
    assert one(spark, X.bigram_split(F.col("t")), t="2024年度報告") == "2024年度 度報 報告"
    assert one(spark, X.bigram_split(F.col("t")), t="plain 年") == "plain 年"
    assert one(spark, X.bigrams(F.col("t")), t="a年度報") == ["年度", "度報"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    r = df.select(X.cosine(F.col("a"), F.col("b")), X.cosine(F.col("a"), F.col("z")), X.cosine(F.col("a"), F.col("s"))).first()
    assert r[0] == pytest.approx(0.7071067) and r[1] == 0 and r[2] == 0


def test_boosts(spark):
    now = F.lit(datetime.datetime(2024, 7, 1)).cast("timestamp_ntz")
    assert one(spark, X.recency_boost(F.lit(datetime.datetime(2023, 7, 2)).cast("timestamp_ntz"), now)) == pytest.approx(0.5)
    assert one(spark, X.recency_boost(F.lit(None).cast("timestamp_ntz"), now)) == 1.0
    assert one(spark, X.recency_boost(F.lit(datetime.datetime(2025, 7, 1)).cast("timestamp_ntz"), F.lit(datetime.datetime(2024, 7, 1)).cast("timestamp_ntz"))) == float("inf")  # as in SQL, no division by zero
    assert one(spark, X.click_boost(F.lit(2), F.lit(0), F.lit(False))) == pytest.approx(0.2)
    assert one(spark, X.click_boost(F.lit(9), F.lit(3), F.lit(True))) == 0.0


def test_folders(spark):
    skipped = lambda n: one(spark, C.skipped_folder(F.col("n")), n=n)
    assert all(map(skipped, ["Windows", "node_modules", "$Recycle.Bin", ".git", "Mail.app", "0f8fad5b-d9cb-469f-a165-70867728950e", "0123456789abcdef"]))
    assert not any(map(skipped, ["Documents", "Projects", "Reports", "My Documents"]))


def test_garbled_and_sizes(spark):
    assert one(spark, X.likely_garbled(F.col("t")), t="#$%" * 30) and not one(spark, X.likely_garbled(F.col("t")), t="abc" * 30)
    assert [one(spark, X.show_size(F.lit(n))) for n in (5, 2048, 5 << 20)] == ["5 B", "2.0 KB", "5.0 MB"]


def test_chunks():
    assert chunk_text("") == [] and chunk_text(None) == []
    assert len(chunk_text("\n\n".join(["p" * 200] * 10))) == 3
    assert len(chunk_text("\n\n".join(["p" * 990] * 600))) == 500
    assert [len(t) for _, t in chunk_text("x" * 3000)] == [1000] * 3
    assert chunk_text("\n\n\n\na\n\n\n\nb") == [(4, "a\n\n\n\nb")]
    assert chunk_text("a\r\n\r\n" + "b" * 1500) == [(0, "a"), (3, "b" * 1000), (1003, "b" * 500)]


def test_chunk_files(spark):
    df = spark.createDataFrame([(1, "a\n\nb", 3), (2, None, 4), (3, "", 5)], "file_id int, text string, extra int")
    assert [tuple(r) for r in chunk_files(df).collect()] == [(1, 3, 0, "a\n\nb", 0, 4)]


def test_batches_are_worked_on_in_slices(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(X.pa, "array", lambda v, t: seen.append(len(v)) or pa.lib.array(v, t))
    got = X.in_slices(pa.lib.array(["The Running dogs", None, "é"] * 300), X.porter_terms, pa.list_(pa.string()))
    assert got.to_pylist() == [["the", "run", "dog"], [], ["e"]] * 300 and max(seen) <= X.SLICE
    assert X.in_slices(pa.lib.array([], pa.string()), X.porter_terms, pa.list_(pa.string())).to_pylist() == []


def test_chunks_of_whole_texts(spark):
    assert len(chunk_text("\n\n".join(["p" * 990] * 600), most=None)) == 600
    texts = ["".join(f"{i:07} " for i in range(100_000)), "a\n\nb", None, "x" * 700_001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = chunk_files(df, most=None).orderBy("id", "chunk_index").collect()
    assert [tuple(r) for r in got] == [(i, n, p, s, s + len(p)) for i, t in enumerate(texts) for n, (s, p) in enumerate(chunk_text(t, most=None))]
    assert ["".join(r["text"] for r in got if r["id"] == i) for i in (0, 3)] == [texts[0], texts[3]]
