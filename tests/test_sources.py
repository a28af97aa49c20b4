import io
import json
import os
import struct
import zipfile
import zlib

import pytest

from lumenspan.sources import compose
from lumenspan.sources import extract as E
from lumenspan.sources import scan
from lumenspan.streaming import jobs, processors


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def docx():
    table = f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p></w:tc><w:tc><w:p>{run('b')}</w:p></w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body><w:p>{run('Hello ')}{run('world')}</w:p><w:p/>{table}</w:body></w:document>"})


def xlsx():
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c></row><row/></sheetData></worksheet>',
        }
    )


def pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    return zipped(
        {
            "ppt/presentation.xml": f'<p xmlns:p="x" {R}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
            "ppt/slides/slide1.xml": f"<s {a}><a:t>Title</a:t><a:t> </a:t><a:t>Body</a:t></s>",
        }
    )


def odt():
    return zipped({"content.xml": '<office xmlns:text="t"><text:p>One &amp; two</text:p><text:h>Three<text:tab/>four</text:h></office>'})


def hwpx():
    return zipped({"Contents/section0.xml": '<s xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"><hp:t> 본문 </hp:t></s>'})


def pdf(shown: bytes, packed: bool = True, extra: bytes = b""):
    body = b"BT /F1 12 Tf 10 10 Td " + shown + b" ET"
    data = zlib.compress(body) if packed else body
    head = b"<< /Length %d %s>>" % (len(data), b"/Filter /FlateDecode " if packed else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj\n4 0 obj " + head + b"\nstream\n" + data + b"\nendstream endobj\n5 0 obj << /Type /Font >> endobj\n" + extra + b"trailer << /Root 1 0 R >>"


def hwp(sections: list[bytes], preview: str = "") -> bytes:
    """A small compound file: streams of under 4096 bytes in the mini stream."""
    names = [("Root Entry", 5, b""), ("PrvText", 2, preview.encode("utf-16-le")), ("FileHeader", 2, b"\0" * 36 + b"\1\0\0\0"), ("BodyText", 1, b""), ("Section0", 2, sections[0])]
    mini, fat, starts = b"", [], {}
    for name, kind, data in names:
        if kind == 2 and data:
            n = -(-len(data) // 64)
            starts[name] = len(fat)
            fat += [len(fat) + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
            mini += data.ljust(n * 64, b"\0")
    sectors = -(-len(mini) // 512)
    links = {"Root Entry": (-1, -1, 1), "PrvText": (-1, 2, -1), "FileHeader": (-1, 3, -1), "BodyText": (-1, -1, 4), "Section0": (-1, -1, -1)}
    entries = b""
    for name, kind, data in names:
        raw = name.encode("utf-16-le") + b"\0\0"
        start, size = (3 + 1, len(mini)) if kind == 5 else (starts.get(name, 0xFFFFFFFE), len(data))
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<iii", *links[name]) + b"\0" * 36 + struct.pack("<IQ", start, size)
    entries = entries.ljust(1024, b"\0")
    fat_sector = struct.pack("<128I", *([0xFFFFFFFD, 2, 0xFFFFFFFE, 0xFFFFFFFE] + [4 + i + 1 for i in range(sectors - 1)] + [0xFFFFFFFE] + [0xFFFFFFFF] * (128 - 4 - sectors)))
    mini_fat = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    head = E.OLE_MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 3, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + fat_sector + entries + mini_fat + mini.ljust(sectors * 512, b"\0")


def section(text: str) -> bytes:
    units = struct.pack(f"<{len(text) + 8}H", 2, *[0] * 7, *map(ord, text))
    record = struct.pack("<I", 67 | len(units) << 20) + units
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(record) + packer.flush()


@pytest.mark.parametrize(
    ("ext", "data", "text", "kind"),
    [
        (".txt", "héllo".encode(), "héllo", "text"),
        ("html", b"<html><style>x</style><p>a &amp; b</p><script>1</script></html>", "a & b", "text"),
        (".docx", docx(), "Hello world\na\tb\n", "text"),
        (".xlsx", xlsx(), "[One]\nname\t12\n\n", "sheet"),
        (".pptx", pptx(), "[Slide 1]\nTitle Body\n", "slide"),
        (".odt", odt(), "One & two\nThree\tfour", "text"),
        (".hwpx", hwpx(), "본문\n", "text"),
        (".rtf", rb"{\rtf1{\*\generator x;}Caf\'e9\par two\tab x}", "Café\ntwo\tx", "text"),
        (".pdf", pdf(rb"(Hello \(pdf\)) Tj"), "Hello (pdf)\n", "text"),
        (".pdf", pdf(rb"[(Wo) -20 (rd) -300 (two)] TJ", False), "Word two\n", "text"),
        (".hwp", hwp([section("문서 본문")]), "문서 본문\n", "text"),
        (".hwp", hwp([section("x")], "미리보기 <a>"), "미리보기  a ", "text"),
    ],
)
def test_formats(ext, data, text, kind):
    got = E.extract(data, ext)
    assert (got["success"], got["text"], got["source_type"]) == (True, text, kind), got


@pytest.mark.parametrize(
    ("ext", "data", "code"),
    [
        (".exe", b"x", "UNSUPPORTED"),
        (".eml", b"x", "UNSUPPORTED_IN_PIPELINE"),
        (".txt", b"x" * (E.TEXT_LIMIT + 1), "TOO_LARGE"),
        (".txt", None, "FILE_NOT_FOUND"),
        (".docx", b"no zip", "INVALID_ZIP"),
        (".docx", E.OLE_MAGIC + b"\0" * 600, "ENCRYPTED"),
        (".odt", zipped({"x": ""}), "INVALID_ODF"),
        (".odt", zipped({"content.xml": "<a/>"}), "EMPTY"),
        (".odt", zipped({"content.xml": "<a"}), "PARSE_ERROR"),
        (".pdf", b"nothing", "PARSE_ERROR"),
        (".pdf", pdf(b"(x) Tj", extra=b"6 0 obj << /Encrypt 7 0 R >> endobj\n"), "ENCRYPTED"),
        (".pdf", pdf(b"(" + b"#%$ 12 " * 20 + b") Tj"), "GARBLED_TEXT"),
        (".hwp", b"nothing", "PARSE_ERROR"),
    ],
)
def test_failures(ext, data, code):
    assert E.extract(data, ext)["error_code"] == code


@pytest.fixture
def tree(tmp_path):
    for name, data in {"doc1.txt": "first text here", "doc2.md": "second text here", "sub/doc3.csv": "a,b,c,d,e,f,g,h", "node_modules/package.json": '{"name": "long enough"}', "tiny.txt": "x"}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)
    (tmp_path / "root/sub/report.docx").write_bytes(docx())
    return tmp_path


def test_scan(spark, tree):
    files = scan.scan(spark, str(tree / "root"), content=True)
    got = {r["filename"]: r for r in scan.with_text(files).collect()}
    assert set(got) == {"doc1.txt", "doc2.md", "doc3.csv", "report.docx"}
    assert got["report.docx"]["text"].startswith("Hello world") and got["doc3.csv"]["folder_path"].endswith("/sub")
    assert {r["filename"] for r in scan.folders(files).collect()} == {"root", "sub"}
    summary = scan.dump(scan.with_text(files), str(tree / "out"), only=["txt", ".md"])
    assert {(r["extension"], r["result"], r["n"]) for r in summary.collect()} == {(".txt", "SUCCESS", 1), (".md", "SUCCESS", 1)}
    assert scan.parse_size("10MB") == 10 << 20 and scan.parse_size("7") == 7


def test_streaming_ingest(spark, tree):
    out, mark = str(tree / "out"), str(tree / "mark")
    jobs.ingest(spark, str(tree / "root"), out, mark).awaitTermination()
    assert jobs.tables(spark, out)[0].count() == 4
    (tree / "root/late.txt").write_text("a late text file")
    jobs.ingest(spark, str(tree / "root"), out, mark).awaitTermination()
    assert jobs.tables(spark, out)[0].count() == 5
    assert jobs.tables(spark, out)[1].where("text = 'a late text file'").count() == 1


def _stream(spark, tmp_path, rows):
    src = tmp_path / "events"
    src.mkdir()
    for i, part in enumerate(rows):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # the file source reads older files first
    schema = "event_id long, user_id long, ts timestamp, event_type string, query string, path string, position int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), spark.read.schema(schema).json(str(src))


def _event(i, user, second, kind, query):
    return {"event_id": i, "user_id": user, "ts": f"2024-01-01T00:{second // 60:02}:{second % 60:02}Z", "event_type": kind, "query": query, "path": "/A/x.txt/", "position": i}


def test_streaming_bounces_match_batch(spark, tmp_path):
    from lumenspan.operators.feedback import bounces

    first = [_event(1, 1, 0, "click", "plan"), _event(2, 1, 5, "view", "budget"), _event(3, 2, 0, "click", "plan"), _event(4, 2, 5, "view", "plans")]
    second = [_event(5, 1, 20, "click", "budget"), _event(6, 1, 40, "view", "roadmap"), _event(7, 3, 30, "click", "x")]
    last = [_event(8, 9, 1800, "view", "z"), _event(9, 9, 1900, "view", "z")]
    stream, batch = _stream(spark, tmp_path, [first, second, last])
    q = processors.bounces(stream, 10.0, "10 seconds").writeStream.format("memory").queryName("bounced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r["is_bounce"] for r in spark.table("bounced").collect()}
    want = {r["event_id"]: r["is_bounce"] for r in bounces(batch, 10.0).collect()}
    assert want == {1: True, 3: False, 5: False, 7: False}
    assert got == want


def test_streaming_clicks(spark, tmp_path):
    rows = [[_event(1, 1, 0, "click", "Plan"), _event(2, 1, 5, "click", "plan ")], [_event(3, 1, 9, "click", "plan")]]
    stream, _ = _stream(spark, tmp_path, rows)
    keys, out = ["query", "path_key"], str(tmp_path / "sink")
    jobs.click_counts(stream).writeStream.outputMode("update").foreachBatch(jobs.upsert_sink(out, keys)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = jobs.latest(spark, out, keys).collect()
    assert [(r["query"], r["path_key"], r["click_count"], r["position"]) for r in got] == [("plan", "/a/x.txt", 3, 1)]


def test_windows(spark, tmp_path):
    rows = [[_event(1, 1, 0, "key", "p"), _event(2, 1, 0, "key", "pl"), _event(3, 1, 30, "key", "q")]]
    _, batch = _stream(spark, tmp_path, rows)
    assert {(r["query"], r["keystrokes"]) for r in jobs.typing_sessions(batch, "1 second").collect()} >= {("q", 1)}
    assert jobs.event_counts(batch, "10 minutes").collect()[0]["n"] == 3


def test_embedded_sql_functions(spark):
    from lumenspan.plans.api import register_functions

    register_functions(spark)
    assert spark.sql("select fts_stem('running') a, split_bigrams('年度報') b, html_unescape('a&amp;b') c, fts_terms('Running dogs') d").first().asDict() == {"a": "run", "b": "年度 度報", "c": "a&b", "d": ["run", "dog"]}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        (r"{\rtf1 plain}", "plain"),
        (r"{\rtf1{\*\generator x y;}kept{\b bold}}", "keptbold"),
        (r"{\rtf1{\*\a{\b in}out}z}", "inoutz"),
        (r"a\par b\line c\tab d\parx e", "a\nb\nc\td" + "e"),
        (r"\'41\'e9\u8364?", "Aé?"),
        (r"a\par\par\par\par b", "a\n\nb"),
        (r"\f1\fs24 x\b0 y", "xy"),
        ("{unclosed", "unclosed"),
        ("closed}", "closed"),
    ],
)
def test_rtf_text(source, text):
    assert E.rtf_text(source) == text


@pytest.mark.parametrize("ext", sorted(compose.WRITERS))
def test_composed_files_are_read(ext):
    lines = ["First line", "zweite Zeile: é & <ü>", "", "x" * 9000]
    got = E.extract(compose.WRITERS[ext](lines), ext)
    assert got["success"], got
    for x in lines[:2]:
        assert x.replace(" ", "\t") in got["text"] or x in got["text"]
    assert "x" * 9000 in got["text"]


def test_composed_preview():
    assert E.extract(compose.hwp(["본문"] * 3000, True), ".hwp")["text"] == "\r\n".join(["본문"] * 3000)
    assert E.extract(compose.hwp(["본문 하나"] * 40_000), ".hwp")["text"] == "본문 하나\n" * 40_000
