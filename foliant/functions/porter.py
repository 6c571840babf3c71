"""Porter stemmer for English, applied to distinct vocabulary words only."""

from __future__ import annotations

import re
from functools import lru_cache


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel)."""
    shape = ""
    for i, char in enumerate(word):
        is_vowel = char in "aeiou" or (char == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if is_vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


# fixed values: suffix rules of the published algorithm, in order of trial per step
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    fitting = [r for r in rules if word.endswith(r[0])]
    if fitting:
        suffix, new = max(fitting, key=lambda r: len(r[0]))
        stem = word[: -len(suffix)]
        if _measure(stem) > 0:
            return stem + new
    return word


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past forms
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix):
                if _has_vowel(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _doubled(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _ends_cvc(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    longest = max((s for s in _STEP4 if word.endswith(s)), key=len, default="")
    if longest:
        base = word[: -len(longest)]
        if _measure(base) > 1 and (longest != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
