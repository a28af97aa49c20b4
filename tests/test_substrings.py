"""Parts of names by stored trigrams, against plain search."""

import datetime
import random

from lumenspan.operators import substrings as G

NAMES = ["Report 2024.docx", "report_final.DOCX", "é.md", "a", "", "보고서 양식.hwp", "100%_sure.txt", "x" * 300, "ab", "aba.b", "🙂 smile.png"]


def test_parts_of_names(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"f{i}", n, f"/Corpus/{i % 3}/{n}") for i, n in enumerate(NAMES)]
    rows += [(f"g{i}", "".join(rng.choice("abcAB._ ") for _ in range(rng.randrange(1, 9))), "/q/" + "".join(rng.choice("abc/") for _ in range(5))) for i in range(60)]
    rows += [("n", None, "/none"), ("m", "only a name", None)]
    start = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([(*r, start + datetime.timedelta(hours=rng.randrange(50))) for r in rows], "file_id string, filename string, path string, modified_at timestamp_ntz")
    G.build(files, str(tmp_path))
    own, held = G.Substrings(spark, str(tmp_path)), files.collect()
    has = lambda r, w: any(w.lower() in (r[c] or "").lower() for c in ("filename", "path"))

    for words in (["report"], ["a"], ["ab"], ["É"], ["보고"], ["양식."], ["%_"], ["x" * 299], ["🙂"], ["zzz"], ["abab", "q/"], ["b.", "A"], ["docx", "2024"], ["b/c"], ["none"], ["name"]):
        for every in (True, False):
            fits = [r for r in held if (all if every else any)(has(r, w) for w in words)]
            got = own.search(files, words, every, 1000).collect()
            assert {r["file_id"] for r in got} == {r["file_id"] for r in fits}, (words, every)
            assert [r["modified_at"] for r in got] == sorted((r["modified_at"] for r in fits), reverse=True)
    assert own.search(files, [], True).collect() == [] == own.search(files, [""], False).collect()
    assert own.candidates("report").count() == 2 and own.rarest("zzzz") is None
    empty = str(tmp_path / "empty")
    G.build(files.limit(0), empty)
    assert G.exists(spark, empty) and G.Substrings(spark, empty).search(files, ["a"]).collect() == []
