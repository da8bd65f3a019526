"""Words of a text: lower case, stop words out, optional stemming."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A word may contain single points ("e.g" is one word). Runs of word characters and
# points are found with one class, so that a long run needs no recursion; points at the ends go.
RUN = r"[\p{L}\p{N}_.]++"
POINTS = r"\.{2,}+"
MIN_LENGTH = 2

# Stop words of the lexical index.
STOP_WORDS = (
    "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we "
    "when will with yet you your"
).split()


def words(text: str | Column) -> Column:
    """Array of index words in text order."""
    text = F.col(text) if isinstance(text, str) else text
    parted = F.regexp_replace(F.lower(text), POINTS, " ")
    runs = F.regexp_extract_all(parted, F.lit(RUN), F.lit(0))
    found = F.transform(runs, lambda w: F.btrim(w, F.lit(".")))
    return F.filter(found, lambda w: (F.length(w) >= MIN_LENGTH) & ~w.isin(STOP_WORDS))


# The suffix rules below are those of M. F. Porter, "An algorithm for suffix stripping" (1980).
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
)


def _shape(stem: str) -> str:
    """The stem as v (vowel) and c (consonant) letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and len(stem) >= 3 and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], floor: int) -> str:
    """Replace the longest matching suffix if the rest has a measure above ``floor``."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + table[suffix] if _measure(rest) > floor else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(rest):
                word = rest
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _STEP_2, 0)
    word = _swap(word, _STEP_3, 0)
    endings = {s: "" for s in _STEP_4}
    if word.endswith(("sion", "tion")):
        word = word[:-3] if _measure(word[:-3]) > 1 else word
    else:
        word = _swap(word, endings, 1)
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem_words(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values)
    return pd.Series([stem(w) for w in distinct], dtype=object).take(codes).reset_index(drop=True)
