"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re

#: Suffixes and what replaces them in steps 2, 3 and 4 of the paper.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, pairs: list[tuple[str, str]], least: int) -> str:
    for suffix, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        double = len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c"
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif double and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
