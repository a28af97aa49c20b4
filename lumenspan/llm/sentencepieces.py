"""Unigram encoding and decoding of sentence pieces.

Pieces lie in a double-array trie; the best segmentation of a text is a Viterbi path
over piece scores. Characters that no piece covers cost the unknown score and become
byte pieces. Spaces are written as the marker U+2581, one is put before each text, and
decoding undoes both. No piece holds a marker behind another character, so a best path
passes through every place before a run of markers, and none holds a line end: texts
are cut there and each
distinct stretch is segmented once, many at a time in numpy, long ones one by one.

The scores are whatever the model file gives its pieces. The public model at hand was
trained as byte-pair merges, so its scores are merge ranks (0, -1, -2, ...), not log
probabilities; the best path is the one of the largest sum either way.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_STRETCHES = 400_000
#: Stretches of up to this many characters are segmented together; longer ones by themselves.
TOGETHER = 64
#: Stretches of more bytes are read position by position: there a round in numpy for each byte costs more than it saves.
LONG = 256
STRETCH = re.compile(r"\n| +[^ \n]*|[^ \n]+")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: texts in UTF-8 (empty for control pieces) with scores; ids of byte pieces by byte."""

    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores, byte_ids = [], np.zeros(len(model)), np.full(256, -1, np.int64)
    for i in range(len(model)):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        texts.append(model.id_to_piece(i).encode() if plain else b"")
        scores[i] = model.get_score(i)
    return Pieces(texts, scores, byte_ids, model.unk_id())


class DoubleArray:
    """Trie of byte strings in two arrays: child of node n by byte b is base[n] + b if check of that slot is n; ``value`` is a string's number or -1."""

    def __init__(self, texts: list[bytes]):
        nested: list[dict[int, int]] = [{}]
        number = [-1]
        for i, text in enumerate(texts):
            node = 0
            for b in text:
                nxt = nested[node].get(b)
                if nxt is None:
                    nxt = nested[node][b] = len(nested)
                    nested.append({})
                    number.append(-1)
                node = nxt
            if text:
                number[node] = i
        size = 4 * len(nested) + 4096
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        self.check[0] = 0
        slot, roomy = [0] * len(nested), 1
        self.value[0] = number[0]
        for node in self._by_depth(nested):
            edges = np.array(sorted(nested[node]))
            if not len(edges):
                continue
            low = roomy
            while True:  # the least base from ``roomy`` on whose slots are all free, looked for a stretch at a time
                taken = np.zeros(512, bool)
                for b in edges:
                    taken |= used[low + b : low + b + 512]
                if not taken.all():
                    break
                low += 512
                if low + 2048 >= len(used):
                    used = np.append(used, np.zeros(size, bool))
                    self.base, self.check, self.value = (np.append(x, np.full(size, fill, np.int32)) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            base = low + int(taken.argmin())
            # Full regions aren't searched again.
            if low - roomy >= 1024 or used[roomy : roomy + 512].mean() > 0.9:
                roomy += 512
            at = slot[node]
            self.base[at] = base
            used[base + edges] = True
            self.check[base + edges] = at
            for b in edges.tolist():
                child = nested[node][b]
                self.value[base + b] = number[child]
                slot[child] = base + b
        last = max(slot) + 257
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    @staticmethod
    def _by_depth(nested: list[dict[int, int]]) -> list[int]:
        order = [0]
        for node in order:
            order.extend(nested[node].values())
        return order


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.trie = pieces, DoubleArray(pieces.texts)
        known = pieces.scores[[i for i, t in enumerate(pieces.texts) if t]]
        self.unknown_score = float(known.min() if len(known) else 0) - UNKNOWN_PENALTY
        mark = MARK.encode()
        if any("\n" in t.decode("utf-8", "replace") or MARK in t.decode("utf-8", "replace").lstrip(MARK) for t in pieces.texts):
            raise ValueError("a piece holds a line end, or the space marker behind another character")
        # What decoding writes for each id.
        self.written = [t.replace(mark, b" ") for t in pieces.texts]
        for b, i in enumerate(pieces.byte_ids):
            if i >= 0:
                self.written[i] = bytes([b])
        self.known: dict[str, bytes] = {}

    def segment(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of each byte string's best path, as unsigned 32-bit little-endian numbers. Of equally good paths the one whose last piece starts first wins, as positions are read upwards."""
        short = iter(self._segment_together([s for s in stretches if len(s) <= LONG]))
        return [next(short) if len(s) <= LONG else self.segment_long(s) for s in stretches]

    @cached_property
    def _lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.pieces.scores.tolist()

    def segment_long(self, data: bytes) -> bytes:
        """``segment`` of one byte string of any length; holds 16 bytes for each of its bytes."""
        (base, check, value, scores), n = self._lists, len(data)
        size, least = len(check), float("-inf")
        score, back, via = array("d", [0.0]) + array("d", [least]) * n, array("i", [-1]) * (n + 1), array("i", [-1]) * (n + 1)
        for i, lead in enumerate(data):
            here = score[i]
            if here == least or lead & 0xC0 == 0x80:
                continue
            char = min(n, i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4))
            single, node, j = False, 0, i
            while j < n:
                at = base[node] + data[j]
                if not 0 < at < size or check[at] != node:
                    break
                node = at
                j += 1
                piece = value[at]
                if piece >= 0:
                    single |= j == char
                    total = here + scores[piece]
                    if total > score[j]:
                        score[j], back[j], via[j] = total, i, piece
            if not single and here + self.unknown_score > score[char]:
                score[char], back[char], via[char] = here + self.unknown_score, i, -1
        out, at = [], n
        while at > 0:
            out.append((via[at], back[at], at))
            at = back[at]
        return self._ids(data, reversed(out))

    def _ids(self, data: bytes, path) -> bytes:
        """Ids of a path of (piece or -1, start, end), unknown characters as bytes."""
        ids: list[int] = []
        for p, low, high in path:
            if p >= 0:
                ids.append(p)
            else:
                fallback = self.pieces.byte_ids[np.frombuffer(data[low:high], np.uint8)]
                ids.extend(fallback if (fallback >= 0).all() else [self.pieces.unknown])
        return np.array(ids, "<u4").tobytes()

    def _segment_together(self, stretches: list[bytes]) -> list[bytes]:
        n = len(stretches)
        long = np.fromiter(map(len, stretches), np.int64, n)
        width = int(long.max()) if n else 0
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width) < long[:, None]] = np.frombuffer(b"".join(stretches), np.uint8)
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0
        back = np.full((n, width + 1), -1, np.int32)  # start of the last piece
        via = np.full((n, width + 1), -1, np.int32)  # its id, -1: unknown character
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            lead = data[:, i]
            start = np.flatnonzero((i < long) & (lead & 0xC0 != 0x80))
            if not len(start):
                continue
            chars = np.where(lead[start] < 0x80, 1, np.where(lead[start] < 0xE0, 2, np.where(lead[start] < 0xF0, 3, 4)))
            chars = np.minimum(chars, long[start] - i)
            single = np.zeros(len(start), bool)
            rows, place, node, j = start, np.arange(len(start)), np.zeros(len(start), np.int64), i
            while len(rows):
                at = base[node] + data[rows, j].astype(np.int64)
                ok = check[np.minimum(at, len(check) - 1)] == node
                ok &= (at < len(check)) & (at > 0)
                rows, place, node, j = rows[ok], place[ok], at[ok], j + 1
                piece = value[node]
                hit = piece >= 0
                if hit.any():
                    r, p = rows[hit], piece[hit]
                    single[place[hit]] |= chars[place[hit]] == j - i
                    total = score[r, i] + self.pieces.scores[p]
                    better = total > score[r, j]
                    r = r[better]
                    score[r, j], back[r, j], via[r, j] = total[better], i, p[better]
                more = long[rows] > j
                rows, place, node = rows[more], place[more], node[more]
            r, end = start[~single], i + chars[~single]
            total = score[r, i] + self.unknown_score
            better = total > score[r, end]
            r, end = r[better], end[better]
            score[r, end], back[r, end], via[r, end] = total[better], i, -1
        # All paths are walked back together, one piece a round.
        ends, rows, kept, owner = long.copy(), np.arange(n), [], []
        while len(rows):
            at = ends[rows]
            kept.append(np.stack([via[rows, at], back[rows, at], at]))
            owner.append(rows)
            ends[rows] = back[rows, at]
            rows = rows[ends[rows] > 0]
        if not kept:
            return [b""] * n
        owner = np.concatenate(owner)
        order = np.lexsort((-np.arange(len(owner)), owner))
        piece, first, at = np.concatenate(kept, 1)[:, order]
        counts = np.bincount(owner, minlength=n)
        stops = np.cumsum(counts)
        flat = piece.astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip((4 * (stops - counts)).tolist(), (4 * stops).tolist(), strict=True)]
        for k in np.unique(owner[order][piece < 0]):
            own = slice(stops[k] - counts[k], stops[k])
            out[k] = self._ids(stretches[k], zip(piece[own], first[own], at[own], strict=True))
        return out

    def _learn(self, stretches: set[str]) -> None:
        new = sorted((s for s in stretches if s not in self.known), key=len)
        low = 0
        while low < len(new):
            high = low + 1
            while high < len(new) and high - low < 8192 and len(new[high]) <= max(TOGETHER, len(new[low])):
                high += 1
            some = new[low:high]
            self.known.update(zip(some, self.segment([s.replace(" ", MARK).encode("utf-8", "surrogatepass") for s in some]), strict=True))
            low = high

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers; none for null and empty texts."""
        if len(self.known) > CACHE_STRETCHES:
            self.known.clear()
        cut = [STRETCH.findall(" " + t) if t else [] for t in texts]
        self._learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes in turn, markers as spaces, without the space put in front; bad UTF-8 becomes U+FFFD."""
        data = b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Unigram] = {}


def sentence_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_ids, ids_crc32 (of the ids as unsigned 32-bit little-endian), round_trip (decoding gives the text), and ids if asked for.

    Null and empty texts have no ids and round-trip. A text that itself holds U+2581
    doesn't, as that decodes to a space. Rows that repeat an id are encoded each; null
    ids are kept. Empty tables give no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def make():
        # A worker process goes on with the trie and the stretches of its earlier tasks.
        if model_path not in _models:
            _models[model_path] = Unigram(shared.value)
        model = _models[model_path]

        def step(keys, texts):
            ids = model.encode(texts)
            out = {id_col: keys, "n_ids": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": [model.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]}
            return out | ({"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]} if with_ids else {})

        return step

    schema = T.StructType([docs.schema[id_col], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return map_rows(docs, [id_col, text_col], make, schema, 512)
