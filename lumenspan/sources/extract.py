"""Text of files by format, from their bytes (SRC3-SRC13, FN31). Each reader returns (text, source type) or raises ``Failed``."""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree as ET

MB = 1 << 20
TEXT_LIMIT, ENTRY_LIMIT = 10 * MB, 50 * MB


class Failed(Exception):
    """A file that can't be read; ``code`` tells why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code, self.detail = code, detail


def _limited(data: bytes, limit: int) -> bytes:
    if len(data) > limit:
        raise Failed("TOO_LARGE", f"{len(data)} bytes")
    return data


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in node.iter() if _local(e.tag) == name]


def _inner(node: ET.Element) -> str:
    return "".join(node.itertext())


def _lines(parts) -> str:
    return "".join(f"{p}\n" for p in parts)


def plain(data: bytes, limit: int = TEXT_LIMIT) -> tuple[str, str]:
    """SRC3"""
    return _limited(data, limit).decode("utf-8-sig", "replace"), "text"


def markup(data: bytes) -> tuple[str, str]:
    """SRC4"""
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", _limited(data, TEXT_LIMIT).decode("utf-8", "replace"))
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", text))).strip(), "text"


def _zip(data: bytes) -> zipfile.ZipFile:
    if data[:8] == OLE_MAGIC:  # an office file in an encrypted container
        raise Failed("ENCRYPTED")
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Failed("INVALID_ZIP", str(e)) from e


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _relations(z: zipfile.ZipFile, name: str, base: str) -> dict[str, str]:
    node = _part(z, name)
    targets = {} if node is None else {r.get("Id"): r.get("Target") for r in node}
    return {k: v.lstrip("/") if v.startswith("/") else f"{base}/{v}" for k, v in targets.items()}


def docx(data: bytes) -> tuple[str, str]:
    """SRC6: top-level paragraphs, and table rows with their cells parted by tabs."""
    doc = _part(_zip(data), "word/document.xml")
    body = next(iter(_all(doc, "body")), None) if doc is not None else None
    out = []
    for e in body if body is not None else ():
        runs = lambda n: "".join(_inner(r) for r in _all(n, "r"))
        if _local(e.tag) == "p" and runs(e).strip():
            out.append(runs(e))
        elif _local(e.tag) == "tbl":
            out += ["\t".join(runs(c).strip() for c in _all(row, "tc")) for row in _all(e, "tr")]
    return _lines(out), "text"


def xlsx(data: bytes) -> tuple[str, str]:
    """SRC7: per sheet its name in brackets and its rows."""
    z = _zip(_limited(data, TEXT_LIMIT))
    book, strings = _part(z, "xl/workbook.xml"), _part(z, "xl/sharedStrings.xml")
    shared = [] if strings is None else [_inner(s) for s in strings if _local(s.tag) == "si"]
    places = _relations(z, "xl/_rels/workbook.xml.rels", "xl")

    def cell(c: ET.Element) -> str:
        value = next((_inner(v) for v in c if _local(v.tag) == "v"), None)
        if value is None:
            return ""
        return shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value

    out = []
    for n, s in enumerate([] if book is None else _all(book, "sheet"), 1):
        ref = next((v for k, v in s.attrib.items() if _local(k) == "id"), "")
        page = _part(z, places.get(ref, ""))
        rows = [] if page is None else ["\t".join(map(cell, (c for c in r if _local(c.tag) == "c"))).strip() for r in _all(page, "row")]
        rows = [r for r in rows if r]
        if rows:
            out += [f"[{s.get('name') or f'Sheet{n}'}]", *rows, ""]
    return _lines(out), "sheet"


def pptx(data: bytes) -> tuple[str, str]:
    """SRC8: per slide its number and its texts."""
    z = _zip(data)
    deck = _part(z, "ppt/presentation.xml")
    places = _relations(z, "ppt/_rels/presentation.xml.rels", "ppt")
    out = []
    for n, s in enumerate([] if deck is None else _all(deck, "sldId"), 1):
        ref = next((v for k, v in s.attrib.items() if k.startswith("{") and _local(k) == "id"), "")
        page = _part(z, places.get(ref, ""))
        text = "" if page is None else " ".join(t.text for t in _all(page, "t") if t.text and t.text.strip())
        if text:
            out += [f"[Slide {n}]", text]
    return _lines(out), "slide"


def hwpx(data: bytes) -> tuple[str, str]:
    """SRC10: text elements of the sections, in the format's own namespace first, else in any of its maker's, else any."""
    z, out = _zip(data), []
    names = sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d*\.xml", n, re.I))
    for name in names:
        if z.getinfo(name).file_size > ENTRY_LIMIT:
            continue
        found = _all(ET.fromstring(z.read(name)), "t")
        for own in ("http://www.hancom.co.kr/hwpml/2011/paragraph", "hancom", ""):
            some = [t for t in found if own in t.tag.partition("}")[0]]
            if some:
                break
        out += [_inner(t).strip() for t in some if _inner(t).strip()] if found else []
    return _lines(out), "text"


def odf(data: bytes) -> tuple[str, str]:
    """SRC11"""
    z = _zip(data)
    if "content.xml" not in z.namelist():
        raise Failed("INVALID_ODF")
    if z.getinfo("content.xml").file_size > ENTRY_LIMIT:
        raise Failed("ZIP_ENTRY_TOO_LARGE")
    text = z.read("content.xml").decode("utf-8", "replace")
    ET.fromstring(text)  # broken markup is an error
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    text = re.sub(r"(?i)</text:[ph]>|<text:line-break\s*/>", "\n", re.sub(r"<text:tab\s*/>", "\t", text))
    text = re.sub(r"<[^>]+>", "", text)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(name, char)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    if not text:
        raise Failed("EMPTY")
    return text, "text"


#: One step of an RTF text: a hexadecimal escape, a control word with its number and space, a control symbol, a brace, or plain text.
RTF_STEP = re.compile(r"\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<word>[A-Za-z]+)(?:-?\d+)?[ \r\n\t]?|\\(?P<symbol>[^A-Za-z])|(?P<brace>[{}])|(?P<text>[^\\{}]+)")
RTF_ENDS = {"par": "\n", "line": "\n", "tab": "\t"}


def rtf_text(source: str) -> str:
    """FN31: one walk over the text's steps; what stands in groups that readers may skip (those that begin with a starred control word and hold no other group) is left out."""
    out: list[str] = []
    starts: list[int] = []  # of the open groups, in ``out``
    nested = starred = False
    for step in RTF_STEP.finditer(source):
        if step["brace"] == "{":
            starts.append(len(out))
            nested = starred = False
        elif step["brace"]:
            if starts:
                start = starts.pop()
                if starred and not nested:
                    del out[start:]
            nested, starred = True, False
        elif step["symbol"]:
            if step["symbol"] == "*":
                starred = bool(starts) and not nested and len(out) == starts[-1]
            elif step["symbol"] in "\\~":
                out.append("\\" if step["symbol"] == "\\" else " ")
            elif step["symbol"] in "{}":
                out.append(step["symbol"])
        else:
            out.append(chr(int(step["hex"], 16)) if step["hex"] else RTF_ENDS.get(step["word"], "") if step["word"] else step["text"])
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def rtf(data: bytes) -> tuple[str, str]:
    """SRC12"""
    return rtf_text(_limited(data, TEXT_LIMIT).decode("utf-8", "replace")), "text"


# -- compound files -----------------------------------------------------------

OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
NONE = 0xFFFFFFFA  # sector numbers from here on end a chain


class Compound:
    """Streams of an OLE compound file by path (storage/stream)."""

    def __init__(self, data: bytes):
        if data[:8] != OLE_MAGIC:
            raise Failed("PARSE_ERROR", "no compound file")
        self.data = data
        self.size, self.mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        count, root = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, mini_fat = struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
        more = struct.unpack_from("<I", data, 68)[0]
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < NONE]
        per = self.size // 4
        while more < NONE and len(tables) < count:
            block = struct.unpack(f"<{per}I", self._sector(more))
            tables += [s for s in block[:-1] if s < NONE]
            more = block[-1]
        self.fat = [x for s in tables for x in struct.unpack(f"<{per}I", self._sector(s))]
        entries = self._chain(root)
        self.entries = []
        for at in range(0, len(entries) - 127, 128):
            e = entries[at : at + 128]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            self.entries.append((name, e[66], *struct.unpack_from("<III", e, 68), *struct.unpack_from("<IQ", e, 116)))
        top = self.entries[0]
        self.mini = self._chain(top[5])
        raw = self._chain(mini_fat)
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw)
        self.paths: dict[str, tuple] = {}
        self._walk(top[4], "")

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < NONE and start < len(self.fat) and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def _walk(self, first: int, base: str) -> None:
        todo, seen = [(first, base)], set()
        while todo:
            n, at = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, _, _ = self.entries[n]
            self.paths[at + name] = self.entries[n]
            todo += [(left, at), (right, at)]
            if kind == 1:
                todo.append((child, f"{at}{name}/"))

    def stream(self, path: str) -> bytes | None:
        if path not in self.paths or self.paths[path][1] != 2:
            return None
        start, size = self.paths[path][5], self.paths[path][6] & 0xFFFFFFFF
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < NONE and start < len(self.mini_fat) and start not in seen:
            seen.add(start)
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def _inflate(raw: bytes) -> bytes:
    for data in (raw, raw[2:]):
        try:
            return zlib.decompressobj(-15).decompress(data)
        except zlib.error:
            continue
    return b""


#: Control characters of paragraph text that take eight places: the extended and inline ones.
WIDE_CONTROLS = frozenset([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23])
PARA_TEXT = 67


def hwp_paragraphs(data: bytes) -> str:
    """Paragraph text of a section's records: tag in 10 bits, level in 10, size in 12 (4095: the size follows)."""
    out, at = [], 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        size, at = head >> 20, at + 4
        if size == 0xFFF and at + 4 <= len(data):
            size, at = struct.unpack_from("<I", data, at)[0], at + 4
        if at + size > len(data):
            break
        if head & 0x3FF == PARA_TEXT:
            units = struct.unpack_from(f"<{size // 2}H", data, at)
            i, line = 0, []
            while i < len(units):
                c = units[i]
                if c in WIDE_CONTROLS:
                    line.append("\t" if c == 9 else "")
                    i += 8
                    continue
                line.append("\n" if c in (10, 13) else "" if c < 32 else chr(c))
                i += 1
            out.append("".join(line).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
        at += size
    return "".join(p if p.endswith("\n") else p + "\n" for p in out)


def hwp(data: bytes) -> tuple[str, str]:
    """SRC9: the preview text, else the sections' paragraphs."""
    doc = Compound(data)
    base = f"{doc.entries[0][0]}/" if doc.entries and f"{doc.entries[0][0]}/PrvText" in doc.paths else ""
    preview = (doc.stream(f"{base}PrvText") or b"").decode("utf-16-le", "replace").strip("\0").strip()
    if preview:
        return re.sub("[<>]", " ", preview), "text"
    head = doc.stream(f"{base}FileHeader")
    packed = head is None or len(head) > 36 and head[36] & 1
    out, n = [], 0
    while (raw := doc.stream(f"{base}BodyText/Section{n}")) is not None:
        out.append(hwp_paragraphs(_inflate(raw) if packed else raw))
        n += 1
    return "".join(out), "text"


# -- PDF ------------------------------------------------------------------------


def garbled(text: str) -> bool:
    """FN24"""
    return len(text) >= 50 and sum(map(str.isalpha, text)) / len(text) < 0.2


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|(?=\d+\s+\d+\s+obj\b)|\Z)", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)


def _pdf_string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain_ = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else plain_.get(m[1], m[1]), token[1:-1])


def _to_unicode(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out.update((int(a, 16), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            out.update((int(a, 16) + i, first[:-1] + chr(ord(first[-1]) + i)) for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)))
    return out


def pdf(data: bytes) -> tuple[str, str]:
    """SRC5: text shown by each page's content, with fonts' ToUnicode maps; pages of mostly non-letters are dropped.

    Reads plain and Flate streams and object streams; other filters give no text.
    """
    if not data.lstrip()[:5] == b"%PDF-":
        raise Failed("PARSE_ERROR", "no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
        raise Failed("ENCRYPTED")
    objects = {int(n): body for n, body in _OBJECT.findall(data)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        try:
            return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else b"" if b"/Filter" in body[: m.start()] else m[1]
        except zlib.error:
            return b""

    for body in list(objects.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            inner = stream(body)
            first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            numbers = list(map(int, inner[:first].split()))[: 2 * n]
            ends = [*numbers[3::2], len(inner) - first]
            for number, start, end in zip(numbers[::2], numbers[1::2], ends, strict=False):
                objects.setdefault(number, inner[first + start : first + end])

    def refs(body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def fonts(page: bytes) -> dict[bytes, dict[int, str] | None]:
        place = page
        for _ in range(8):  # resources may be inherited
            found = re.search(rb"/Font\s*<<(.*?)>>", place, re.S)
            ref = refs(place, b"Resources")
            if not found and ref:
                place = objects.get(ref[0], b"")
                found = re.search(rb"/Font\s*<<(.*?)>>", place, re.S)
            if not found and refs(place, b"Font"):
                found = re.search(rb"(.*)", objects.get(refs(place, b"Font")[0], b""), re.S)
            if found:
                out = {}
                for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", found[1]):
                    font = objects.get(int(n), b"")
                    cmap = refs(font, b"ToUnicode")
                    out[b"/" + name] = _to_unicode(stream(objects.get(cmap[0], b""))) if cmap else None
                    if cmap and b"/Type0" in font:
                        out[b"/" + name][-1] = ""  # two-byte codes
                return out
            parent = refs(page, b"Parent")
            if not parent:
                break
            page = place = objects.get(parent[0], b"")
        return {}

    texts, bad = [], 0
    pages: list[bytes] = []
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    todo, seen = refs(root, b"Pages"), set()
    while todo:
        n = todo.pop(0)
        if n in seen:
            continue
        seen.add(n)
        body = objects.get(n, b"")
        kids = refs(body, b"Kids")
        todo = kids + todo
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            pages.append(body)
    for page in pages:
        maps, now, stack, out = fonts(page), None, [], []
        content = b"\n".join(stream(objects.get(n, b"")) for n in refs(page, b"Contents"))

        def show(token: bytes) -> str:
            raw = _pdf_string(token)
            if not now:
                return raw.decode("cp1252", "replace")
            step = 2 if -1 in now else 1
            return "".join(now.get(int.from_bytes(raw[i : i + step], "big"), "") for i in range(0, len(raw), step))

        for token in _TOKEN.findall(content):
            if token[:1] in b"(</[]" or token[:1].isdigit() or token[:1] in b"+-.":
                stack.append(token)
                continue
            if token == b"Tf":
                name = next((t for t in stack if t[:1] == b"/"), b"")
                now = maps.get(name)
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    out.append("\n")
                for t in stack:
                    if t[:1] in (b"(", b"<"):
                        out.append(show(t))
                    elif token == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", t) and float(t) < -200:
                        out.append(" ")
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET") and out and not out[-1].endswith("\n"):
                out.append("\n")
            stack = []
        text = "".join(out).strip()
        if garbled(text):
            bad += 1
        elif text:
            texts.append(text)
    if bad and not texts:
        raise Failed("GARBLED_TEXT")
    return _lines(texts), "text"


READERS: dict[str, Callable[[bytes], tuple[str, str]]] = {
    **dict.fromkeys((".txt", ".md", ".csv", ".json", ".log", ".xml"), plain),
    ".pdf": pdf,
    ".docx": docx,
    ".xlsx": xlsx,
    ".pptx": pptx,
    ".hwp": hwp,
    ".hwpx": hwpx,
    ".html": markup,
    ".htm": markup,
    ".rtf": rtf,
    **dict.fromkeys((".odt", ".ods", ".odp"), odf),
}


def extract(data: bytes | None, ext: str | None, whole: bool = False) -> dict:
    """SRC13: success, text, source_type, error_code, error_detail of one file; a broken file never stops the job. With ``whole`` plain texts may have any size."""
    ext = (ext or "").lower()
    ext = ext if ext.startswith(".") else f".{ext}"
    out = {"success": False, "text": None, "source_type": None, "error_code": None, "error_detail": None}
    if ext in (".eml", ".msg"):
        return out | {"error_code": "UNSUPPORTED_IN_PIPELINE"}
    if ext not in READERS:
        return out | {"error_code": "UNSUPPORTED", "error_detail": ext}
    if data is None:
        return out | {"error_code": "FILE_NOT_FOUND"}
    try:
        reader = READERS[ext]
        text, kind = plain(data, len(data)) if whole and reader is plain else reader(data)
    except Failed as e:
        return out | {"error_code": e.code, "error_detail": e.detail or None}
    except Exception as e:  # what a broken file raises can't be listed
        return out | {"error_code": "PARSE_ERROR", "error_detail": f"{type(e).__name__}: {e}"[:500]}
    return out | {"success": True, "text": text, "source_type": kind}
