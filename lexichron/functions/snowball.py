"""The English Snowball stemmer (Porter2), as its published description has it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: irregular words, words left alone, and endings by step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_LONG_START = re.compile(r"gener|commun|arsen")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    start = _LONG_START.match(word) or _REGION.search(word)
    first = start.end() if start else len(word)
    second = _REGION.search(word, first)
    return first, second.end() if second else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if ending.startswith("eed"):
        return stem + "ee" if len(stem) >= first else word
    if not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return stem[:-1]
    return stem + "e" if first >= len(stem) and _SHORT_END.search(stem) else stem


@lru_cache(maxsize=50_000)
def snowball(word: str) -> str:
    """The Snowball stem of a word in lower case."""
    word = word.lower().replace("’", "'")
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    first, second = _regions(word)
    word = _plural(re.sub(r"'s'$|'s$|'$", "", word))
    if word in LEFT:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    ending = _longest(word, STEP2)
    if ending and len(word) - len(ending) >= first:
        stem = word[: -len(ending)]
        if ending not in ("ogi", "li") or ending == "ogi" and stem.endswith("l") or ending == "li" and stem[-1:] in tuple("cdeghkmnrt"):
            word = stem + STEP2[ending]
    ending = _longest(word, STEP3)
    if ending and len(word) - len(ending) >= (second if ending == "ative" else first):
        word = word[: -len(ending)] + STEP3[ending]
    ending = _longest(word, STEP4)
    if ending and len(word) - len(ending) >= second and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e") and (len(word) > second or len(word) > first and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def snowball_stem(values: pd.Series) -> pd.Series:
    """Snowball stems; each distinct word of a batch is stemmed once."""
    return values.map({w: snowball(w) for w in values.dropna().unique()})
