"""Smallest valid files of each format from lines of text: samples for readers, and a way to write them."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAWING = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
REFERENCE = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    rows = "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="{RELATIONS}">{rows}</Relationships>'


def docx(lines: list[str]) -> bytes:
    """A paragraph a line."""
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return zipped({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"})


def xlsx(lines: list[str]) -> bytes:
    """One sheet, a row a line, a cell a word; first cells are shared strings."""
    shared, rows = [], []
    for x in lines:
        first, *rest = x.split(" ")
        shared.append(first)
        rows.append(f'<row><c t="s"><v>{len(shared) - 1}</v></c>{"".join(f"<c><v>{escape(w)}</v></c>" for w in rest)}</row>')
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {REFERENCE}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations(["worksheets/sheet1.xml"]),
            "xl/sharedStrings.xml": f"<sst>{''.join(f'<si><t>{escape(x)}</t></si>' for x in shared)}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>",
        }
    )


def pptx(lines: list[str]) -> bytes:
    """A slide a line."""
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(lines) + 1))
    slides = {f"ppt/slides/slide{i}.xml": f"<s {DRAWING}><a:t>{escape(x)}</a:t></s>" for i, x in enumerate(lines, 1)}
    deck = f'<p xmlns:p="x" {REFERENCE}><p:sldIdLst>{ids}</p:sldIdLst></p>'
    return zipped({"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": _relations([f"slides/slide{i}.xml" for i in range(1, len(lines) + 1)])} | slides)


def odt(lines: list[str]) -> bytes:
    """A paragraph a line."""
    return zipped({"content.xml": f'<?xml version="1.0"?><office xmlns:text="t">{"".join(f"<text:p>{escape(x)}</text:p>" for x in lines)}</office>'})


def hwpx(lines: list[str]) -> bytes:
    """A text element a line."""
    body = "".join(f"<hp:t>{escape(x)}</hp:t>" for x in lines)
    return zipped({"Contents/section0.xml": f'<s xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph">{body}</s>'})


def rtf(lines: list[str]) -> bytes:
    """A paragraph a line; Latin-1 letters as hexadecimal escapes."""

    def char(c: str) -> str:
        return f"\\{c}" if c in "\\{}" else f"\\'{ord(c):02x}" if 127 < ord(c) < 256 else c

    return ("{\\rtf1{\\*\\generator x;}" + "\\par ".join("".join(map(char, x)) for x in lines) + "}").encode()


def pdf(lines: list[str]) -> bytes:
    """One page, a line of text a line, in the Windows Latin encoding; what it lacks becomes a question mark."""

    def shown(x: str) -> bytes:
        raw = x.encode("cp1252", "replace")
        for c in (b"\\", b"(", b")"):
            raw = raw.replace(c, b"\\" + c)
        return b"(" + raw + b") Tj"

    data = zlib.compress(b"BT /F1 12 Tf 10 10 Td " + b" T* ".join(map(shown, lines)) + b" ET")
    head = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
    head += b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj\n"
    head += b"4 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n" % len(data)
    return head + data + b"\nendstream endobj\n5 0 obj << /Type /Font >> endobj\ntrailer << /Root 1 0 R >>"


END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(streams: dict[str, bytes]) -> bytes:
    """An OLE compound file of streams by path (storage/stream, one level); all streams in sectors of 512 bytes, none in the mini stream."""
    storages = sorted({p.split("/")[0] for p in streams if "/" in p})
    nodes = [("Root Entry", 5, None)] + [(s, 1, None) for s in storages] + [(p.split("/")[-1], 2, p) for p in streams]
    inside = {s: [i for i, n in enumerate(nodes) if n[2] and n[2].startswith(s + "/")] for s in storages}
    top = [i for i, n in enumerate(nodes) if n[1] == 1 or n[2] and "/" not in n[2]]
    right, child = dict.fromkeys(range(len(nodes)), -1), dict.fromkeys(range(len(nodes)), -1)
    for group, owner in [(top, 0), *[(inside[s], 1 + k) for k, s in enumerate(storages)]]:
        child[owner] = group[0] if group else -1
        right.update(zip(group, group[1:], strict=False))  # a chain of right siblings is a valid tree
    chains, body = [], b""
    directory = -(-len(nodes) // 4)

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        start = len(chains)
        chains.extend([start + i + 1 for i in range(n - 1)] + [END])
        nonlocal body
        body += data.ljust(n * 512, b"\0")
        return start

    put(b"\0" * 512 * directory)  # the directory's place
    starts = {p: put(data) for p, data in streams.items() if data}
    entries = b""
    for i, (name, kind, path) in enumerate(nodes):
        raw = name.encode("utf-16-le") + b"\0\0"
        start, size = (starts.get(path, END), len(streams[path])) if path else (END if kind == 5 else 0, 0)
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<iii", -1, right[i], child[i]) + b"\0" * 36 + struct.pack("<IQ", start, size)
    body = entries.ljust(512 * directory, b"\0") + body[512 * directory :]
    tables = 1
    while tables * 128 < len(chains) + tables:
        tables += 1
    if tables > 109:
        raise ValueError("too large for the header's table of sectors")
    table = chains + [FAT] * tables
    table += [FREE] * (tables * 128 - len(table))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    # A cutoff of 0: no stream is small enough for the mini stream.
    head += struct.pack("<IIIIIIII", tables, 0, 0, 0, END, 0, END, 0)
    head += struct.pack("<109I", *[len(chains) + i for i in range(tables)], *[FREE] * (109 - tables))
    return head + body + struct.pack(f"<{len(table)}I", *table)


def hwp(lines: list[str], preview: bool = False) -> bytes:
    """A document of one section with a paragraph a line, packed; or only its preview text."""
    records = b""
    for x in lines:
        units = x.encode("utf-16-le", "surrogatepass") + b"\x0d\0"
        size = len(units)
        records += struct.pack("<I", 67 | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + units
    packer = zlib.compressobj(wbits=-15)
    packed = packer.compress(records) + packer.flush()
    shown = "\r\n".join(lines).encode("utf-16-le", "surrogatepass") if preview else b""
    return compound({"PrvText": shown, "FileHeader": b"\0" * 36 + b"\1\0\0\0", "BodyText/Section0": packed})


def plain(lines: list[str]) -> bytes:
    return "\n".join(lines).encode("utf-8", "surrogatepass")


def html(lines: list[str]) -> bytes:
    return f"<html><head><style>p{{}}</style></head><body>{''.join(f'<p>{escape(x)}</p>' for x in lines)}<script>x</script></body></html>".encode("utf-8", "surrogatepass")


WRITERS = {".txt": plain, ".html": html, ".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".odt": odt, ".rtf": rtf, ".hwpx": hwpx, ".hwp": hwp, ".pdf": pdf}
