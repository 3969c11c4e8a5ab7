"""Cleaning of words and n-grams as column expressions, and the Porter stemmer.

Everything but the stemmer stays in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters deleted from words, which leaves the straight apostrophe.
PUNCTUATION = r"""[,.;:!?@#$~^&*{}°"’\[\]()_\-\p{Nd}+]+"""

# Words replaced by others, in the order given.
WORDS = {
    "Century": "century",
    "christian": "Christian",
    "Biblical": "biblical",
    "Church": "church",
    "Faith": "faith",
    "Apostle": "apostle",
    "american": "American",
    "jewish": "Jewish",
    "roman": "Roman",
    "testament": "Testament",
    "Lord": "lord",
    "Pauls": "Paul",
    "Gods": "God",
    "churches": "church",
    "men": "man",
    "St": "saint",
    "st": "saint",
    "Rom": "Romans",
    "rom": "Romans",
    "Cor": "Corinthians",
    "cor": "Corinthians",
    "Gal": "Galatians",
    "Phil": "Philippians",
    "Thess": "Thessalonians",
    "Nt": "New Testament",
    "nt": "New Testament",
    "Ot": "Old Testament",
    "ot": "Old Testament",
}
# Pairs of words that are one, in the order given.
COLLOCATIONS = {
    "Greco Roman": "Greco_Roman",
    "Graeco Roman": "Greco_Roman",
    "Acts Luke": "Luke_Acts",
    "Luke act": "Luke_Acts",
    "Christian Jewish": "Jewish_Christian",
    "Judeo Christian": "Judeo_Christian",
    "Judaeo Christian": "Judeo_Christian",
    "Paul s": "Paul",
    "Denis Saint": "Saint_Denis",
    "Pauline deutero": "deutero_Pauline",
    "Deutero Pauline": "deutero_Pauline",
    "Saxon anglo": "Anglo_Saxon",
    "Murphy Oconnor": "Murphy_Oconnor",
    "Engberg Pedersen": "Engberg_Pedersen",
    "New Testament": "New_Testament",
    "Old Testament": "Old_Testament",
    "New York": "New_York",
}

#: White space as Unicode has it, alike in Spark and DuckDB.
SPACES = r"[\t-\r \x{85}\p{Z}]+"
#: Words of two or more letters, digits or underscores, alike in Spark and DuckDB.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """The words of a text between white space of any script."""
    return F.filter(F.split(_col(text), SPACES), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """The tokens of a text; none of a null text."""
    return F.coalesce(F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def ngrams(list_of_tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces, without a window. Give it a column, not an expression: it is read once per run."""
    last = F.size(list_of_tokens) - n + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(list_of_tokens, i, n), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def recased(word: Column) -> Column:
    """First letter as it is, the others in lower case."""
    return F.concat(F.substring(word, 1, 1), F.lower(word.substr(F.lit(2), F.length(word))))


def cleaned_words(list_of_words: Column, stopwords: list[str], again: bool = False) -> Column:
    """Each word without punctuation and digits, recased; the empty string for stop words (as typed) and single characters.

    With ``again`` words that are stop words once recased are emptied too.
    """
    stripped = F.transform(list_of_words, lambda w: F.regexp_replace(w, PUNCTUATION, ""))
    kept = F.transform(stripped, lambda w: F.when(w.isin(stopwords) | (F.length(w) <= 1), F.lit("")).otherwise(recased(w)))
    return F.transform(kept, lambda w: F.when(w.isin(stopwords), F.lit("")).otherwise(w)) if again else kept


def joined(list_of_words: Column) -> Column:
    """Words that aren't empty, joined by spaces."""
    return F.array_join(F.filter(list_of_words, lambda w: w != ""), " ")


def clean_filter(text: Column | str, stopwords: list[str]) -> Column:
    """Words without punctuation and digits, stop words (as typed) and single characters dropped, the rest recased."""
    return joined(cleaned_words(words(text), stopwords))


def clean_ngram(text: Column | str, stopwords: list[str]) -> Column:
    """``clean_filter``, and stop words dropped once more after recasing."""
    return joined(cleaned_words(words(text), stopwords, again=True))


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def clean_token(word: Column | str) -> Column:
    """A word without anything but letters, digits and underscores, recased."""
    return recased(F.regexp_replace(_col(word), r"[^\p{L}\p{N}_]", ""))


def ascii_only(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[^\x00-\x7f]", "")


def strip_digits(text: Column | str) -> Column:
    """Digits deleted, but only where one follows something else, so pure numbers and words after digits stay."""
    text = _col(text)
    return F.when(text.rlike(r"\P{Nd}\p{Nd}"), F.regexp_replace(text, r"\p{Nd}+", "")).otherwise(text)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def replaced_words(text: Column | str, replacements: dict[str, str] = WORDS) -> Column:
    """Each word replaced as the map says; a value may be two words."""
    return F.array_join(F.transform(words(text), lambda w: F.coalesce(_map(replacements)[w], w)), " ")


def merged_collocations(text: Column | str, collocations: dict[str, str] = COLLOCATIONS) -> Column:
    """Pairs of words that are one merged, wherever the two stand in the text: the merged word takes the first one's place.

    The pairs are folded over the words one after another, so a later pair may hold a word that an earlier one made.
    """
    pairs = F.array(*[F.struct(*[F.lit(x) for x in (*pair.split(), merged)]) for pair, merged in collocations.items()])

    def merge(found: Column, pair: Column) -> Column:
        first, second, merged = (pair[f"col{k}"] for k in (1, 2, 3))
        without = F.transform(F.filter(found, lambda w: w != second), lambda w: F.when(w == first, merged).otherwise(w))
        return F.when(F.array_contains(found, first) & F.array_contains(found, second), without).otherwise(found)

    return F.array_join(F.aggregate(pairs, words(text), merge), " ")


def million(number: Column | str) -> Column:
    """``20M``: a number in millions."""
    return F.concat(F.format_number(_col(number) / 1e6, 0), F.lit("M"))


def decimals(number: Column | str, digits: int = 6) -> Column:
    """A number with so many decimals and no thousands separators."""
    return F.format_string(f"%.{digits}f", _col(number).cast("double"))


def clean_ngram_string(text: Column | str) -> Column:
    """Digits stripped, words replaced, collocations merged."""
    return merged_collocations(replaced_words(strip_digits(text)))


def sorted_words(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """The words in order; with ``stopwords`` (possibly none) punctuation and digits are deleted first, and those words dropped."""
    found = words(text)
    if stopwords is not None:
        found = F.transform(found, lambda w: F.regexp_replace(w, PUNCTUATION, ""))
        found = F.filter(found, lambda w: (w != "") & ~w.isin(stopwords) if stopwords else w != "")
    return F.array_join(F.sort_array(found), " ")


def replaced_whole(text: Column | str, replacements: dict[str, str] = COLLOCATIONS) -> Column:
    """The text replaced where the map has it as a whole."""
    return F.coalesce(_map(replacements)[_col(text)], _col(text))


# Fixed values of the published Porter algorithm: endings by step and what they become.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _consonants(word: str) -> str:
    """``c`` or ``v`` for each letter."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _consonants(stem)))


def _ends_cvc(word: str) -> bool:
    return _consonants(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str | None) -> str | None:
    """The Porter stem of a word in lower case."""
    if word is None or len(word) <= 2:
        return word
    w = word.lower()
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _consonants(w[: -len(e)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and _consonants(w)[-1:] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in [*_STEP4, "ion"] if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_text(text: str | None) -> str | None:
    """The Porter stems of the words of a text, in lower case."""
    return None if text is None else " ".join(porter(w) or "" for w in text.lower().split())


@F.pandas_udf(StringType())
def text_stems(values: pd.Series) -> pd.Series:
    return values.map({w: stem_text(w) for w in values.dropna().unique()})


@F.pandas_udf(StringType())
def porter_stem(values: pd.Series) -> pd.Series:
    """Porter stems; each distinct word of a batch is stemmed once."""
    return values.map({w: porter(w) for w in values.dropna().unique()})
