"""Registered queries beside their SQL on the smallest tables, and calls that have none."""

import glob
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumenspan import cli
from lumenspan.functions import wordpieces as W
from lumenspan.operators import index as I
from lumenspan.plans import api, catalogue, engine, language, readers
from lumenspan.sources import corpus as T
from lumenspan.sources import store
from lumenspan.streaming import jobs

OWN = [n for n, f in catalogue.QUERIES.items() if f.__module__ in (engine.__name__, language.__name__, readers.__name__) or n.startswith("fts_")]


@pytest.fixture(scope="module")
def duck(sf):
    con = pytest.importorskip("duckdb").connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_equals_its_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    found = duck.execute(catalogue.ORACLES[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    cell = lambda v: round(float(v), 6) + 0.0 if isinstance(v, (float, Decimal)) else v
    want = sorted(str([cell(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(str(list(map(cell, r))) for r in got.collect()) == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_cache_modes_and_index(spark, sf):
    e, now = engine.engine(spark, sf, "simple"), [0.0]
    e.clock = lambda: now[0]
    first = e.search_files("erin")
    assert e.search_files("erin") is first and e.search_files("erin", 5) is not first
    assert e.search_files("erin", extensions=[".md"]) is not first  # options are part of the key
    now[0] = 31.0
    assert e.search_files("erin") is not first
    e.mode = "no such mode"
    assert e.search_files("erin")["mode"] == "Smart"
    e.mode = "fast"
    assert e.search_files("erin")["mode"] == "Fast"
    for i in range(12):
        e.search_files(f"the erin{i}")
    assert len(e._cache) <= api.CACHE_ENTRIES + 1
    assert all("erin" in i["matchSnippet"].lower() for i in first["items"])


def test_index_of_nothing(spark, sf, tmp_path):
    own = I.ensure(spark, str(tmp_path), lambda: T.chunks(spark, sf).limit(0))
    assert own.search(language.STEM_QUERY).count() == 0
    assert store.names(spark, str(tmp_path)) == [f"version={I.VERSION}-porter"]


def test_cycles():
    import threading
    import time

    seen, gate = [], threading.Event()
    c = api.Cycles([("Scanning", lambda: seen.append("s")), ("Indexing", lambda: gate.wait(5) and seen.append("i"))], every=3600)
    c.start()
    while c.phase != "Indexing":
        time.sleep(0.01)
    assert not c.run_cycle()  # one at a time
    gate.set()
    while c.done < 1:
        time.sleep(0.01)
    c.request_now()
    while c.done < 2:
        time.sleep(0.01)
    c.pause()
    assert c.phase == "Paused" and not c.run_cycle()
    c.resume()
    c.stop()
    assert seen[:4] == ["s", "i", "s", "i"] and c.run_cycle() and c.phase == "Complete"
    bad = api.Cycles([("Embedding", lambda: 1 / 0)])
    assert not bad.run_cycle() and isinstance(bad.error, ZeroDivisionError) and bad.phase == "Idle"
    with pytest.raises(ValueError):
        api.Cycles([("Nowhere", print)])


def test_boosts_of_paths(spark, sf):
    e = api.Engine(T.files(spark, sf), None, F.current_timestamp())
    for i in range(3):
        e.record_click("the plan", "/A/x.txt", 2, 100.0 + i)
    assert e.boost_batch("plan", ["/a/X.TXT/", "/none"]) == {"/a/x.txt": pytest.approx(0.6)}
    with pytest.raises(ValueError):
        e.boost_batch("plan", ["x"] * 901)


def test_upserts_are_compacted(spark, tmp_path):
    write = jobs.upsert_sink(str(tmp_path), ["k"], 3)
    for n in range(8):
        write(spark.createDataFrame([(n % 2, n), (9, n)], "k int, v int"), n)
    assert sorted(os.listdir(tmp_path)) == ["batch=7", "snapshot=6"]
    assert {(r["k"], r["v"]) for r in jobs.latest(spark, str(tmp_path), ["k"]).collect()} == {(0, 6), (1, 7), (9, 7)}


def test_vocabularies(tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n[UNK]\n[CLS]\n[SEP]\nplay\n##ing\n")
    (tmp_path / "a.json").write_text(json.dumps({"model": {"vocab": {"play": 4, "##ing": 5}}, "added_tokens": [{"content": "[CLS]", "id": 2}, {"content": "play", "id": 9}]}))
    (tmp_path / "b.json").write_text(json.dumps({"model": {"vocab": [["<s>", 0], ["a", -1.5]]}}))
    v = W.load_vocabulary(str(tmp_path / "v.txt"))
    assert v["##ing"] == 5 and W.load_vocabulary(str(tmp_path / "a.json")) == {"play": 9, "##ing": 5, "[CLS]": 2}
    assert W.load_vocabulary(str(tmp_path / "b.json")) == {"<s>": 0, "a": 1}
    assert W.word_pieces("playings", v) == ["play", "##ing", "##s"]
    assert W.encoder(v)("Playing, PLAY!") == [2, 4, 5, 4, 3] and W.encoder(v)(None) == [2, 3] and W.encoder(v, 3)("play play") == [2, 4, 3]


def test_sql_functions(spark):
    api.register_functions(spark)
    row = spark.sql("select fts_stem('running') a, family_key('/D', 'Report_v2 (3).pdf') b, cosine_sim(array(1.0D, 0.0D), array(1.0D, 1.0D)) c, html_text('<p>a &amp;  b</p><script>x</script>') d, snippet('some words here', 'WORDS') e").first()
    assert row["a"] == "run" and row["b"] == "/d|report" and row["c"] == pytest.approx(0.7071067811865475) and row["d"] == "a & b" and row["e"] == "some words here"
    long = "x" * 300 + " budget " + "y" * 300
    assert "budget" in spark.sql(f"select snippet('{long}', 'Budget') s").first()["s"]
    assert spark.sql(f"select chunk_index, length(text) n from chunk_text('{'z' * 2500}')").collect()[-1].asDict() == {"chunk_index": 2, "n": 500}


def test_dump(spark, tmp_path, capsys):
    root, out = tmp_path / "in", tmp_path / "out"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("first text here")
    (root / "sub/b.md").write_text("second text here")
    (root / "bad.docx").write_bytes(b"no zip, but long enough")
    (root / "x.exe").write_bytes(b"no content, but long enough")
    assert cli.dump(spark, []) == 1 and cli.dump(spark, [str(tmp_path / "none"), str(out)]) == 1 and cli.dump(spark, [str(root), str(root)]) == 1
    assert cli.dump(spark, [str(root), str(out), "--include-failed"]) == 0
    assert (out / "a.txt.txt").read_text() == "first text here" and (out / "sub/b.md.txt").read_text() == "second text here"
    assert (out / "bad.docx.error.txt").read_text().startswith("ErrorCode: INVALID_ZIP")
    summary = json.loads((out / "_summary.json").read_text())
    assert summary["by_ext"] == {".docx": 1, ".md": 1, ".txt": 1} and summary["by_result"] == {"error": 1, "success": 2} and summary["total_files"] == 3
    assert cli.dump(spark, [str(root), str(out)]) == 3
    assert cli.dump(spark, [str(root), str(out), "--overwrite", "--only", "md", "--max-size", "1KB"]) == 0
    assert json.loads((out / "_summary.json").read_text())["total_files"] == 1


def test_report(spark, tmp_path):
    log, out = tmp_path / "log.tsv", tmp_path / "deep/report.md"
    assert cli.report(spark, ["--input", str(log), "--output", str(out)]) == 1
    log.write_text("# nothing\n")
    assert cli.report(spark, ["--input", str(log), "--output", str(out)]) == 2
    log.write_text('2024-01-01T00:00:00Z\t00:00:00.001\tEXTRACT_FILE\tpath="/a b.txt"\text=.txt\tsize_bytes=10\textract_ms=5\tresult=ok\n')
    assert cli.report(spark, ["--input", str(log), "--output", str(out)]) == 0 and "| .txt |" in out.read_text()


def test_calls_over_lines(spark, sf, tmp_path):
    T.files(spark, sf).write.parquet(f"{tmp_path}/files")
    T.chunks(spark, sf).write.parquet(f"{tmp_path}/chunks")
    said: list[str] = []
    lines = ['{"id": 1, "method": "tools/list"}', '{"id": 2, "method": "tools/call", "params": {"name": "list_indexed_files", "arguments": {"limit": 2}}}', "no json", '{"id": 3, "method": "x"}', '{"id": 4, "method": "tools/call", "params": {"name": "search_files", "arguments": {"query": " "}}}', '{"id": 5, "method": "tools/call", "params": {"name": "search_files", "arguments": {"nope": 1}}}']
    assert cli.serve(spark, ["--files", f"{tmp_path}/files", "--chunks", f"{tmp_path}/chunks"], lines, said.append) == 0
    got = [json.loads(x) for x in said]
    assert len(got[0]["result"]["tools"]) == 4 and got[1]["result"]["count"] == 2 and got[2]["error"]["code"] == -32700
    assert got[3]["error"]["code"] == -32601 and "error" in got[4]["result"] and got[5]["error"]["code"] == -32602
