"""Word-piece token counts by a longest-match automaton.

The vocabulary is a trie; a failure link leads from a trie node to the node of what is
left after its text's longest pieces are taken off the front, and says how many pieces
that popped. Reading a word is one pass over its characters: follow the trie, or count
the popped pieces and follow the failure link. No piece is ever built. Words of a slice
advance together, one character column at a time, in numpy; long words, such as texts
without white space, are read one by one over the same links.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

#: Ends every word; the vocabulary's word-final pieces carry it as END_MARK.
END_MARK = "</w>"
CACHE_WORDS = 400_000
#: Words of more bytes are read by themselves: there a round in numpy for each byte costs more than it saves.
LONG = 128
#: Characters of the texts that are counted together.
CHARS = 3 << 20
#: Splits at ASCII white space; letters, single digits and runs of anything else stand apart.
SPLIT = r"(\pL+|\pN|[^\s\pL\pN]+)"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes, the word end as a trailing byte 0xFF (which no UTF-8 text holds)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    symbols = byte_symbols()
    out = []
    for piece in vocab:
        body, final = (piece[: -len(END_MARK)], b"\xff") if piece.endswith(END_MARK) else (piece, b"")
        if all(c in symbols for c in body):
            out.append(bytes(symbols[c] for c in body) + final)
    return sorted(set(out) | {b"\xff"})


class LongestMatch:
    """Automaton over bytes. ``count`` gives numbers of greedy longest-match pieces; a word with a byte that starts no piece counts 1 (unknown)."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        depth_order = [0]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(piece)
        n = len(children)
        # Breadth first, so a node's parent has its failure link before it.
        fail, pops = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for node in depth_order:
            for b, child in children[node].items():
                depth_order.append(child)
                if final[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                at, popped = fail[node], pops[node]
                while at >= 0 and b not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[child], pops[child] = children[at][b], popped
        self.fail, self.pops = fail, pops
        # Transitions as one sorted array of node * 256 + byte.
        keys = np.fromiter((node * 256 + b for node, edges in enumerate(children) for b in edges), np.int64)
        to = np.fromiter((c for edges in children for c in edges.values()), np.int32)
        order = np.argsort(keys)
        self.root = np.full(256, -1, np.int32)
        self.root[[*children[0]]] = [*children[0].values()]
        self.size = 1 << int(np.ceil(np.log2(max(2, 2 * len(keys)))))
        self.slots, self.to = self._hash(keys[order], to[order])

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressed table, so a transition is found in about one read."""
        slots, values = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int32)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = slots[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            won = left[free][first]
            slots[at[won]], values[at[won]] = keys[won], to[won]
            left = left[slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self.size - 1)
        return slots, values

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child by byte, -1 where there is none."""
        keys = node.astype(np.int64) * 256 + byte
        out = np.full(len(keys), -1, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            seen = self.slots[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            at[todo] = (at[todo] + 1) & (self.size - 1)
        return out

    @cached_property
    def _links(self) -> tuple[dict[int, int], list[int], list[int]]:
        there = self.slots >= 0
        return dict(zip(self.slots[there].tolist(), self.to[there].tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()

    def count_long(self, word: bytes) -> int:
        """Pieces of one word; the word end is added here."""
        (edges, fail, pops), node, total = self._links, 0, 0
        step = edges.get
        for byte in word + b"\xff":
            to = step(node << 8 | byte)
            while to is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = step(node << 8 | byte)
            node = to
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else 1

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; the word end is added here."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._count_together(words)
        out = np.zeros(len(words), np.int64)
        out[[i for i, w in enumerate(words) if len(w) <= LONG]] = self._count_together([w for w in words if len(w) <= LONG])
        out[long] = [self.count_long(words[i]) for i in long]
        return out

    def _count_together(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        long = np.fromiter(map(len, words), np.int64, n) + 1
        order = np.argsort(-long, kind="stable")
        flat = np.frombuffer(b"\xff".join([*words, b""]), np.uint8)
        starts = (np.cumsum(long) - long)[order]
        long = long[order]
        node, total, dead = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(int(long[0]) if n else 0):
            live = np.flatnonzero(~dead[: np.searchsorted(-long, -i, side="left")])
            byte = flat[starts[live] + i]
            while len(live):
                to = self._step(node[live], byte)
                ok = to >= 0
                node[live[ok]] = to[ok]
                live, byte = live[~ok], byte[~ok]
                total[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                lost = node[live] < 0
                dead[live[lost]] = True
                live, byte = live[~lost], byte[~lost]
        # What is left on the way down the trie pops along its failure links to the root.
        live = np.flatnonzero(~dead & (node > 0))
        while len(live):
            total[live] += self.pops[node[live]]
            node[live] = self.fail[node[live]]
            dead[live[node[live] < 0]] = True
            live = live[node[live] > 0]
        out = np.empty(n, np.int64)
        out[order] = np.where(dead, 1, total)
        return out


@cache  # a worker goes on with the automaton and the words of its earlier tasks
def worker_counter(path: str):
    return counter(load_pieces(path))


def counter(pieces: list[bytes]):
    """A function from texts to (words, tokens) of each. Texts are lower-cased and split by SPLIT."""
    automaton = LongestMatch(pieces)
    known: dict[str, int] = {}

    def some(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > CACHE_WORDS:
            known.clear()
        chunks = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        told = chunks.flatten().dictionary_encode()
        mixed = pc.invert(pc.utf8_is_alpha(told.dictionary))
        words = pc.ascii_split_whitespace(pc.replace_with_mask(told.dictionary, mixed, pc.replace_substring_regex(told.dictionary.filter(mixed), SPLIT, r"\1 ")))
        each = words.flatten().dictionary_encode()
        listed = each.dictionary.to_pylist()
        new = [w for w in listed if w not in known]
        if new:
            known.update(zip(new, automaton.count([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))
        picked, ends, at, stops = each.indices.to_numpy(), words.offsets.to_numpy(), told.indices.to_numpy(), chunks.offsets.to_numpy()

        def total(per_word: np.ndarray) -> np.ndarray:
            """Sums per text of numbers per distinct word."""
            per_chunk = np.diff(np.append(0, np.cumsum(per_word[picked]))[ends])
            return np.diff(np.append(0, np.cumsum(per_chunk[at]))[stops])

        # Splitting leaves empty strings at the ends; they are no words.
        n_words = total(np.fromiter((w != "" for w in listed), np.int64, len(listed)))
        return n_words, total(np.fromiter((known[w] if w else 0 for w in listed), np.int64, len(listed)))

    def run(texts: list[str | None]) -> tuple[list[int], list[int]]:
        words, tokens = [], []
        group: list[str] = []
        chars = 0
        for i, t in enumerate(texts):
            group.append(t or "")
            chars += len(t or "")
            if chars > CHARS or i == len(texts) - 1:
                w, k = some(group)
                words += w.tolist()
                tokens += k.tolist()
                group, chars = [], 0
        return words, tokens

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens (greedy longest-match pieces of all words of the whole text).

    Null and empty texts have none. Words of any length are counted whole. Rows that
    repeat an id are counted each; null ids are kept. Empty tables give no rows. Other columns are ignored.
    """

    def make():
        count = worker_counter(vocabulary_path)

        def step(ids, texts):
            words, tokens = count(texts)
            return {id_col: ids, "n_words": words, "n_tokens": tokens}

        return step

    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return map_rows(docs, [id_col, text_col], make, schema, 2048)
