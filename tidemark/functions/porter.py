"""English stems by the published suffix-stripping algorithm of Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The algorithm's suffixes and what they become, by step.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """``c`` for consonants, ``v`` for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel sequence is followed by a consonant one."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table exchanged, if enough of the word is before it."""
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if "v" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z, and of up to two, stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of an array of words, in order; a worker remembers what it has met."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])
