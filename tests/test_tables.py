import pytest
from pyspark.sql import functions as F

from lumenspan.operators import feedback as B
from lumenspan.operators import logs as L
from lumenspan.operators import mutations as M

LINES = [
    '2024-01-01T00:00:00Z\t00:00:00.001\tEXTRACT_FILE\tpath="/a b.txt"\text=.txt\tsize_bytes=10\textract_ms=5\tresult=ok',
    '2024-01-02T00:00:00Z\t00:00:00.002\tEXTRACT_FILE\tpath="/q\\"x.pdf"\text=.pdf\tsize_bytes=-1\textract_ms=100\tresult=error:X',
    "# comment",
    "broken",
    "2024-01-03T00:00:00Z\t00:00:00.003\tPARSE_DETAIL\text=.pdf\tstage=open\ttime_ms=7\ttime_ms=9",
]


@pytest.fixture(scope="module")
def events(spark):
    return L.parse_log(spark.createDataFrame([(x,) for x in LINES], "value string"))


def test_log(spark, events):
    rows = {r["path"]: r for r in L.extracts(events).collect()}
    assert set(rows) == {"/a b.txt", '/q"x.pdf'} and rows["/a b.txt"]["ms"] == 5.0
    assert L.details(events).first()["ms"] == 9.0
    assert {r["bucket"] for r in L.by_size(L.extracts(events)).collect()} == {"<100KB", "unknown"}
    assert L.parse_log(spark.createDataFrame([(x,) for x in LINES], "value string"), "2024-01-02").count() == 2
    assert "| .pdf |" in L.markdown({"Failures": L.failures(L.extracts(events))})


@pytest.mark.parametrize("n", [1, 2, 10, 20, 101])
def test_percentiles(spark, n):
    rows = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("ms"))
    xs = sorted(float(i % 7) for i in range(n))
    r = L.percentiles(rows, ["k"], [50, 95]).first()
    assert (r["p50"], r["p95"]) == (xs[min(n * 50 // 100, n - 1)], xs[min(n * 95 // 100, n - 1)])


def test_quoting_round_trip(spark):
    value = 'a "b" \\ c=d'
    line = spark.range(1).select(L.log_line(F.lit("t"), F.lit("e"), F.lit("C"), {"k": F.lit(value), "n": F.lit(3)}).alias("value"))
    assert L.parse_log(line).first()["kv"] == {"k": value, "n": "3"}


def test_upsert(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    changes = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("c", 9, 1)], "id string, n int, turn int")
    assert {tuple(r) for r in M.upsert(table, changes, ["id"], "turn").collect()} == {("a", 1, "x"), ("b", 7, "y"), ("c", 9, None)}
    assert M.upsert(table, changes.limit(0), ["id"]).count() == 2


def test_telemetry(spark):
    s = spark.createDataFrame([("Fast", 10, 0), ("Smart", 15, 2)], "mode string, duration_ms long, results int")
    r = B.telemetry(s, F.lit(5000)).first().asDict()
    assert r == {"searches": 2, "empty": 1, "mean_ms": 12, "fast": 1, "smart": 1, "deep": 0, "files_bucket": "1k-10k"}
    left = B.subtract(spark.createDataFrame([(5, 3)], "a long, b long"), spark.createDataFrame([(2, 4)], "a long, b long"), ["a", "b"]).first()
    assert tuple(left) == (3, 0)


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
