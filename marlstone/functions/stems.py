"""Stems of English words by Porter's algorithm (1980), for columns of distinct words.

Word forms repeat, so stem each word of a vocabulary once and join the stems back
(``stemmed``); the rows with their many repeats never reach Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Suffixes of the published steps with what replaces them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and others than a-z, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    ending = _longest(word, ("sses", "ies", "ss", "s"))
    word = word[: len(word) - {"sses": 2, "ies": 2, "s": 1}.get(ending, 0)]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        ending = _longest(word, ("ed", "ing"))
        if ending and "v" in _shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        ending = _longest(word, step)
        if ending and _measure(word[: -len(ending)]) > 0:
            word = word[: -len(ending)] + step[ending]
    ending = _longest(word, STEP_4)
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e"):
        rest = _measure(word[:-1])
        if rest > 1 or (rest == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stemmed(rows: DataFrame, column: str, name: str = "stem") -> DataFrame:
    """``rows`` with the stem of a word column; a null word has none."""
    known = rows.select(column).filter(F.col(column).isNotNull()).distinct().select(column, stems(column).alias(name))
    return rows.join(known, column, "left").select(*rows.columns, name)
