"""Word pieces of embedding models: vocabulary files and encoding (SRC18, FN27, FN37)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import in_slices

#: Words are parted by white space and punctuation, which is dropped.
PARTED = regex.compile(r"[\s\p{P}]+")
MOST_IDS = 8192
START, END, PAD, UNKNOWN = ("[CLS]", "<s>"), ("[SEP]", "</s>"), ("[PAD]", "<pad>"), ("[UNK]", "<unk>")


def load_vocabulary(path: str) -> dict[str, int]:
    """SRC18: piece to id from a tokenizer's JSON file (an object of ids or a list of pieces, then its added tokens) or from lines of pieces."""
    with open(path, encoding="utf-8") as f:
        if not path.endswith(".json"):
            return {piece: i for i, line in enumerate(f) if (piece := line.strip())}
        whole = json.load(f)
    own = whole.get("model", {}).get("vocab") or {}
    pieces = dict(own) if isinstance(own, dict) else {e[0]: i for i, e in enumerate(own) if isinstance(e, list) and e}
    return pieces | {t["content"]: t["id"] for t in whole.get("added_tokens", ()) if "content" in t and "id" in t}


def special(vocabulary: dict[str, int], names: tuple[str, ...], default: int = 0) -> int:
    """The id of the first of some names that there is."""
    return next((vocabulary[n] for n in names if n in vocabulary), default)


def word_pieces(word: str, vocabulary: dict[str, int], longest: int | None = None) -> list[str]:
    """Greedy longest pieces; a character that starts none stands alone. ``longest`` bounds the pieces looked for."""
    longest = longest or max(map(len, vocabulary), default=1)
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(min(len(word), at + longest), at, -1) if mark + word[at:e] in vocabulary), at + 1)
        out.append(mark + word[at:end])
        at = end
    return out


def encoder(vocabulary: dict[str, int], most: int = MOST_IDS):
    """FN27: a function from texts to ids, between those of start and end; at most ``most`` in all."""
    first, last, unknown = (special(vocabulary, n) for n in (START, END, UNKNOWN))
    longest, known = max(map(len, vocabulary), default=1), {}

    def ids(word: str) -> list[int]:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = [vocabulary.get(p, unknown) for p in word_pieces(word, vocabulary, longest)]
        return known[word]

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        for word in PARTED.split((text or "").lower()):
            if len(out) >= most - 2:
                break
            if word:
                out += ids(word)
        return [first, *out[: most - 2], last]

    return encode


def encode(text: Column, vocabulary: dict[str, int], most: int = MOST_IDS) -> Column:
    """FN27: ids of each text; the attention mask is one for all of them. The vocabulary goes to the workers with the function."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, encoder(vocabulary, most), pa.list_(pa.int64()))

    return run(text)


def to_blob(vector: Column) -> Column:
    """FN28: a vector as bytes, four a number, little end first."""
    @F.pandas_udf(T.BinaryType())
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector)


def from_blob(blob: Column) -> Column:
    """FN28"""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(blob)
