"""Porter's two English stemmers, from their published rules. The index uses the first, snippets the second."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL = "aeiou"


_KINDS = {k: "v" if chr(k) in VOWEL else "c" for k in range(128)}


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    if "y" not in word and word.isascii():
        return word.translate(_KINDS)
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in VOWEL or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")  # each run of vowels before a consonant


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Suffix tables of steps 2, 3 and 4, as published.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_ENDS2, _ENDS3, _ENDS4 = tuple(e for e, _ in STEP2), tuple(e for e, _ in STEP3), tuple(STEP4)


@lru_cache(1 << 18)
def porter1(word: str) -> str:
    """Stem by the 1980 algorithm; words of one or two letters and words beyond a to z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            stem = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table, ends in ((STEP2, _ENDS2), (STEP3, _ENDS3)):
        found = max(((e, n) for e, n in table if word.endswith(e)), key=lambda x: len(x[0])) if word.endswith(ends) else None
        if found and _measure(word[: -len(found[0])]):
            word = word[: -len(found[0])] + found[1]
    if word.endswith(_ENDS4):
        end = max((e for e in STEP4 if word.endswith(e)), key=len)
        stem = word[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# Words that the second stemmer treats by themselves, as published.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
LATE2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
LATE3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
LATE4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
V2 = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Starts of the regions R1 and R2."""

    def after(low: int) -> int:
        m = re.compile(f"[{V2}][^{V2}]").search(word, low)
        return m.end() if m else len(word)

    head = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = head if head is not None else after(0)
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{V2}][{V2}][^{V2}wxY]$", word) or re.fullmatch(f"[{V2}][^{V2}]", word))


@lru_cache(1 << 16)
def porter2(word: str) -> str:
    """Stem by the later English algorithm; lower-cases, and leaves words beyond a to z and the apostrophe."""
    word = word.lower().replace("’", "'")
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in INVARIANT:
        return word
    word = re.sub(f"(^|[{VOWEL}])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{V2}].+s$", word):
        word = word[:-1]
    if word in INVARIANT:
        return word
    found = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), None)
    if found in ("eed", "eedly"):
        if len(word) - len(found) >= r1:
            word = word[: -len(found)] + "ee"
    elif found and re.search(f"[{V2}]", word[: -len(found)]):
        word = word[: -len(found)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_syllable(word) and len(word) <= r1:
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in V2:
        word = word[:-1] + "i"
    for table in (LATE2, LATE3):
        hit = next(((e, n) for e, n in sorted(table, key=lambda x: -len(x[0])) if word.endswith(e)), None)
        if hit and len(word) - len(hit[0]) >= r1:
            stem = word[: -len(hit[0])]
            if hit[0] == "ogi" and not stem.endswith("l") or hit[0] == "li" and stem[-1:] not in set("cdeghkmnrt") or hit[0] == "ative" and len(stem) < r2:
                continue
            word = stem + hit[1]
    end = next((e for e in LATE4 if word.endswith(e)), None)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
