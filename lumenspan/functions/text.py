
from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .stem import porter1, porter2

CJK = "㐀-䶿一-鿿"
HANGUL = "가-힣ㄱ-ㆎ"
TERM = r"[\p{L}\p{N}]+"


# -- identity ---------------------------------------------------------------


def file_id(path: Column) -> Column:
    """FN1: first 16 hex digits of SHA-256 of the lower-cased path with forward slashes."""
    return F.substring(F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256), 1, 16)


def chunk_id(file: Column, index: Column) -> Column:
    """FN1: first 16 hex digits of SHA-256 of ``file:index``."""
    return F.substring(F.sha2(F.concat_ws(":", file, index.cast("string")), 256), 1, 16)


def content_hash(text: Column) -> Column:
    """FN1: SHA-256 in hex."""
    return F.sha2(text, 256)


def click_path(path: Column) -> Column:
    """FN3: lower case without trailing slashes."""
    return F.regexp_replace(F.lower(path), r"[\\/]+$", "")


# -- paths ------------------------------------------------------------------


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def extension(name: Column) -> Column:
    """FN21: lower-cased extension with its dot; empty if none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def normal_extension(ext: Column) -> Column:
    """FN21: lower case, with a leading dot."""
    low = F.lower(F.trim(ext))
    return F.when(low == "", low).when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./\\]*$", "")


def like_escape(text: str) -> str:
    """FN2: ``text`` with LIKE's wildcards taken literally."""
    return re.sub(r"([\\%_])", r"\\\1", text)


# -- words ------------------------------------------------------------------


def simple_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    for c in set(text):
        if unicodedata.combining(c):
            text = text.replace(c, "")
    return text


_RUN = re.compile(r"[^\W_]+")


def folded_words(text: str | None) -> list[str]:
    """Folded runs of letters and digits, in order."""
    return _RUN.findall(unicodedata.normalize("NFC", fold(text))) if text else []


def porter_terms(text: str | None) -> list[str]:
    """FTS1: folded terms, stemmed by Porter's first algorithm."""
    return [porter1(t) for t in folded_words(text)]


#: Rows whose Python values are held at once; a batch from Spark may have ten thousand whole texts.
SLICE = 256


def in_slices(values: pa.Array, one, kind: pa.DataType) -> pa.Array:
    """``one`` of each value, with few of them and of their results as Python objects at a time."""
    parts = [pa.array([one(v) for v in values.slice(low, SLICE).to_pylist()], kind) for low in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def porter_terms_udf(text: pa.Array) -> pa.Array:
    return in_slices(text, porter_terms, pa.list_(pa.string()))


def terms(text: Column, tokenizer: str = "porter") -> Column:
    """FTS1: the terms of a text; ``simple`` stays in the JVM, ``porter`` folds and stems, after CJK bigrams are split."""
    return F.coalesce(simple_terms(text) if tokenizer == "simple" else porter_terms_udf(bigram_split(text)), F.array().cast("array<string>"))


def bigram_split(text: Column) -> Column:
    """FN14, FTS9: overlapping pairs in runs of CJK ideographs, parted by spaces; a text without ideographs stays as it is."""
    return F.when(text.rlike(f"[{CJK}]{{2}}"), _bigrams(text)).otherwise(text)


_CJK_RUN = re.compile(f"[{CJK}]{{2,}}")


def split_bigrams(text: str | None) -> str | None:
    return _CJK_RUN.sub(lambda m: " ".join(m[0][i : i + 2] for i in range(len(m[0]) - 1)), text) if text and not text.isascii() else text


@F.pandas_udf(T.StringType())
def _bigrams(text: pd.Series) -> pd.Series:
    return text.map(split_bigrams, na_action="ignore")


def bigrams(text: Column) -> Column:
    """FN15: pairs of neighbouring CJK ideographs."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.filter(pairs, lambda p: p.rlike(f"^[{CJK}]{{2}}$"))


def is_cjk(text: Column) -> Column:
    """FN13"""
    return text.rlike(f"[{CJK}]")


def is_korean(text: Column) -> Column:
    """FN13"""
    return text.rlike(f"[{HANGUL}]")


def query_tokens(query: Column) -> Column:
    """FN4: split at space, comma, dot, hyphen and underscore; empty parts dropped."""
    return F.filter(F.split(query, r"[ ,.\-_]"), lambda x: x != "")


def strip_particle(token: Column) -> Column:
    """FN6: a Korean token without its particle, the longest listed first."""
    return F.regexp_replace(token, f"(?<=.)({'|'.join(words.KOREAN_PARTICLES)})$", "")


def remove_stop_words(query: Column) -> Column:
    """FN5: the tokens that aren't stop words, Korean ones without particle, joined by spaces."""
    stop = F.array(*[F.lit(w) for w in sorted(words.STOP_WORDS)])
    kept = F.filter(query_tokens(query), lambda x: ~F.array_contains(stop, F.lower(x)))
    bare = F.transform(kept, lambda x: F.when(is_korean(x), strip_particle(x)).otherwise(x))
    return F.array_join(F.filter(bare, lambda x: ~F.array_contains(stop, F.lower(x))), " ")


def family_name(name: Column) -> Column:
    """FN18: a file name without extension, marks, copy and date parts, version words and numbers."""
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), words.FAMILY_STEPS, name))


def family_key(folder: Column, name: Column) -> Column:
    return F.lower(F.concat(F.coalesce(folder, F.lit("")), F.lit("|"), family_name(name)))


def is_copy_name(name: Column) -> Column:
    """FN19"""
    return file_stem(name).rlike(words.COPY_NAME)


def word_boundary_match(name: Column, token: str) -> Column:
    """FTS14: ``token`` in ``name`` with no letter or digit next to it; CJK and Korean neighbours count as boundaries."""
    tall = f"{CJK}{HANGUL}"
    before = rf"(?<![\p{{L}}\p{{N}}&&[^{tall}]])"
    after = rf"(?![\p{{L}}\p{{N}}&&[^{tall}]])"
    return name.rlike(f"(?iu){before}{_quote(token)}{after}")


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\s])", r"\\\1", text) if text.isascii() else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


# -- snippets ---------------------------------------------------------------


def snippet(content: Column, terms: list[str], limit: int = 200, around: int = 100) -> Column:
    """FN16: up to ``limit`` characters around the earliest term; without any, around the first word with a term's stem; else the start."""
    found = [t for t in terms if t and t.strip()]
    head = F.when(F.length(content) <= limit, content).otherwise(F.concat(F.substring(content, 1, limit), F.lit("...")))
    if not found:
        return F.coalesce(head, F.lit(""))
    low = F.lower(content)
    spots = [F.struct(F.locate(t.lower(), low).alias("at"), F.lit(-i).alias("order"), F.lit(len(t)).alias("long")) for i, t in enumerate(found)]
    first = F.array_min(F.filter(F.array(*[F.struct(s["at"].alias("at"), (-s["order"]).alias("order"), s["long"].alias("long")) for s in spots]), lambda s: s["at"] > 0))
    literal = _window(content, first["at"] - 1, first["long"], limit, around)
    stems = [(porter2(t), t) for t in found if not re.search(f"[{HANGUL}]", t)]
    stems = [s for s, t in stems if s and s != t]
    other = head
    for s in reversed(stems):
        word = F.regexp_substr(content, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}]){_quote(s)}[\p{{L}}\p{{N}}]*"))
        at = F.length(F.regexp_replace(content, rf"(?isu)(?<![\p{{L}}\p{{N}}]){_quote(s)}.*$", ""))
        other = F.when(word.isNotNull(), _window(content, at, F.length(word), limit, around)).otherwise(other)
    return F.coalesce(F.when(first.isNotNull(), literal).otherwise(other), F.lit(""))


def _window(content: Column, at: Column, long: Column, limit: int, around: int) -> Column:
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(content), at + long + around, start + limit)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < F.length(content), "...").otherwise(""))


def highlight(text: Column, terms: list[str]) -> Column:
    """FN17: ``<mark>`` around each term, case ignored; a term that doesn't occur marks the words with its stem."""
    out = text
    for t in (t for t in terms if t and t.strip()):
        plain, s = rf"(?iu){_quote(t)}", porter2(t)
        stemmed = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}]){_quote(s)}[\p{{L}}\p{{N}}]*", "<mark>$0</mark>") if s and s != t else out
        out = F.when(out.rlike(plain), F.regexp_replace(out, plain, "<mark>$0</mark>")).otherwise(stemmed)
    return out


# -- numbers, dates, sizes ----------------------------------------------------


def age_days(when: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / F.lit(86400e6)


def recency_boost(when: Column, as_of: Column) -> Column:
    """FTS11: max(0.3, 1 / (1 + days / 365)); 1 where the date is unknown, without bound for a date just 365 days ahead."""
    share = F.coalesce(F.try_divide(F.lit(1.0), 1 + age_days(when, as_of) / 365), F.lit(float("inf")))
    return F.when(when.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), share))


def extension_boost(ext: Column) -> Column:
    """FTS12"""
    table = F.create_map(*[F.lit(x) for pair in words.EXTENSION_BOOST.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit(1.0))


def click_boost(count: Column, position: Column, bounced: Column) -> Column:
    """FTS13"""
    return F.when(bounced, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), count * 0.1) * F.log2(position + F.lit(2.0))))


def show_date(text: Column) -> Column:
    """FN22: yyyy-MM-dd, or the text itself if it isn't a date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), text)


def time_ago(when: Column, as_of: Column) -> Column:
    """FN22"""
    minutes = F.floor(age_days(when, as_of) * 1440).cast("int")
    return F.when(minutes < 1, "just now").when(minutes < 60, F.format_string("%d minutes ago", minutes)).when(minutes < 1440, F.format_string("%d hours ago", F.floor(minutes / 60).cast("int"))).otherwise(F.format_string("%d days ago", F.floor(minutes / 1440).cast("int")))


def show_size(n: Column) -> Column:
    """FN23"""
    kb = 1024.0
    return F.when(n < kb, F.format_string("%d B", n)).when(n < kb**2, F.format_string("%.1f KB", n / kb)).when(n < kb**3, F.format_string("%.1f MB", n / kb**2)).otherwise(F.format_string("%.1f GB", n / kb**3))


def likely_garbled(text: Column) -> Column:
    """FN24: at least 50 characters, of which under a fifth are letters."""
    return (F.length(text) >= 50) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text) < 0.2)


def abbreviate(ext: Column) -> Column:
    """FN36: a short upper-case label of an extension."""
    low = F.lower(ext)
    return F.when(low.isin(".doc", ".docx"), "DOC").when(low.isin(".xls", ".xlsx", ".csv"), "XLS").when(low.isin(".ppt", ".pptx"), "PPT").when(low == ".pdf", "PDF").when(low.isin(".hwp", ".hwpx"), "HWP").otherwise(F.upper(F.substring(F.regexp_replace(low, r"^\.", ""), 1, 3)))


# -- vectors ------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """FN25: 0 for different dimensions and for zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """FN26: a vector of length one; the zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


# -- markup -------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """FN30: character references decoded."""
    return in_slices(text, lambda v: None if v is None else html.unescape(v), pa.string())


def html_text(markup: Column) -> Column:
    """SRC4: text without scripts, styles and tags, references decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"\s+", " "))


def xml_unescape(text: Column) -> Column:
    """FN30: the five XML references, the ampersand first, so ``&amp;lt;`` becomes ``<``."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")], text)
