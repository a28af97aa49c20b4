"""From a search box's words to a boolean expression of terms, phrases and prefixes (FN4-FN11, FTS2-FTS4)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import words
from .text import CJK, HANGUL

PHRASE = re.compile('"([^"]+)"')


@dataclass(frozen=True)
class Atom:
    """Consecutive terms; with ``prefix`` the last one may go on."""

    text: str
    prefix: bool = False

    def __str__(self) -> str:
        return '"' + self.text.replace('"', '""') + '"' + "*" * self.prefix


@dataclass(frozen=True)
class All:
    parts: tuple

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.parts)) + ")"


@dataclass(frozen=True)
class Any:
    parts: tuple

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.parts)) + ")"


Query = Atom | All | Any


def _join(kind, parts):
    parts = tuple(parts)
    return parts[0] if len(parts) == 1 else kind(parts)


def tokens(query: str) -> list[str]:
    """FN4"""
    return [t for t in re.split(r"[ ,.\-_]", query) if t]


def is_stop(token: str) -> bool:
    return token.lower() in words.STOP_WORDS


def has_korean(text: str) -> bool:
    return re.search(f"[{HANGUL}]", text) is not None


def has_cjk(text: str) -> bool:
    return re.search(f"[{CJK}]", text) is not None and not has_korean(text)


def remove_stop_words(query: str) -> str:
    """FN5, FN6"""
    bare = [strip_particle(t) if has_korean(t) else t for t in tokens(query) if not is_stop(t)]
    return " ".join(t for t in bare if t and not is_stop(t))


def strip_particle(token: str) -> str:
    """FN6"""
    found = next((p for p in words.KOREAN_PARTICLES if token.endswith(p) and len(token) > len(p)), "")
    return token.removesuffix(found)


def bigrams(text: str) -> list[str]:
    """FN15"""
    return re.findall(f"(?=([{CJK}]{{2}}))", text)


def expand(query: str) -> list[str]:
    """FN10, SET3: what the expansion table adds for a query's words and for the query as a whole, in first-seen order."""
    parts = query.split(" ")
    keys = [p for p in parts if p]
    if len(keys) > 1:
        keys.append(query.strip())
    seen: dict[str, str] = {}
    for key in keys:
        for e in words.EXPANSIONS.get(key.lower(), ()):
            seen.setdefault(e.lower(), e)
    return list(seen.values())


def keyword_expansions(query: str) -> list[str]:
    return [e for e in expand(query) if not e.startswith(".")]


def hyphen_expansions(query: str) -> list[str]:
    """FN11: remainders behind a known prefix, then hyphenated words written as one."""
    out = []
    for t in tokens(query):
        if is_stop(t) or has_korean(t) or len(t) < 4:
            continue
        prefix = next((p for p in words.COMPOUND_PREFIXES if len(t) >= len(p) + 3 and t.lower().startswith(p)), None)
        if prefix:
            out.append(t[len(prefix) :])
    joined = (w.replace("-", "") for w in re.split("[ ,.]", query) if "-" in w)
    return out + [j for j in joined if len(j) >= 4 and not is_stop(j)]


def korean_parts(found: list[str]) -> list[str]:
    """FN8: the first Korean token of three letters or more that gives two or more pairs."""
    for t in found:
        pairs = [t[i : i + 2] for i in range(0, len(t) - 1, 2)] if has_korean(t) and len(t) >= 3 else []
        if len(pairs) >= 2:
            return pairs
    return []


def _token(token: str) -> Query:
    if has_cjk(token):
        pairs = bigrams(token)
        return All(tuple(Atom(p, True) for p in pairs)) if len(pairs) >= 2 else Atom(token, True)
    return Atom(token, has_korean(token) or len(token) >= 4 or token.upper() in words.ACRONYMS)


def _words(query: str) -> Query | None:
    found = tokens(query)
    parts = [_token(t) for t in found if not is_stop(t)]
    if not parts:
        return None
    out = _join(Any, parts)
    pairs = korean_parts(found)
    if pairs:
        out = Any((out, All(tuple(Atom(p, True) for p in pairs))))
    more = list(dict.fromkeys(keyword_expansions(query) + hyphen_expansions(query)))
    if more:
        out = Any((out, _join(Any, [Atom(e, True) for e in more])))
    return out


def parse(query: str | None) -> Query | None:
    """FN7: the expression of a query; None if it holds nothing to search for.

    Quoted parts are phrases, and all of them must occur; of the other words any may
    (Q30: every phrase counts, not the first alone).
    """
    if not query or not query.strip():
        return None
    phrases = [Atom(p.strip()) for p in PHRASE.findall(query) if p.strip()]
    rest = _words(PHRASE.sub(" ", query).replace('"', " "))
    parts = [*phrases, *([rest] if rest else [])]
    return _join(All, parts) if parts else None


def atoms(query: Query) -> list[Atom]:
    """The distinct atoms of an expression, in order."""
    if isinstance(query, Atom):
        return [query]
    return list(dict.fromkeys(a for p in query.parts for a in atoms(p)))
