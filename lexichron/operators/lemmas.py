"""Lemmas of n-grams by a lemmatiser that is handed in: dictionary, application, cleaning of a vocabulary.

A lemmatiser is a function from a list of texts to, for each, its tokens as
(lemma, part of speech).  It runs over Arrow batches of *distinct* n-grams, so its
cost grows with the vocabulary and not with the corpus.  A lemma of null, and
what it gives for a null text, count as nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.operators import bags

Lemmatiser = Callable[[list[str]], Iterable[list[tuple[str, str]]]]

# Parts of speech that are kept.
KEPT = ("NOUN", "ADJ", "VERB", "PROPN")


def lemmatised(ngrams: DataFrame, lemmatise: Lemmatiser, keep: Iterable[str] = KEPT, key: str = "ngram") -> DataFrame:
    """``key, lemmas``: of each distinct n-gram the lemmas of the tokens whose part of speech is kept, in their order."""
    kept = frozenset(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = lemmatise(batch.column(0).to_pylist())
            lemmas = [[lemma for lemma, tag in tokens if lemma and tag in kept] for tokens in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lemmas, pa.list_(pa.string()))], names=[key, "lemmas"])

    return ngrams.select(key).filter(F.col(key).isNotNull()).distinct().mapInArrow(run, f"{key} string, lemmas array<string>")


def lemma_dictionary(merged: DataFrame, lemmatise: Lemmatiser, above: int = 5, least_lemmas: int = 1, keep: Iterable[str] = KEPT) -> DataFrame:
    """``ngram, lemmata, n`` of the n-grams with a count above ``above`` and so many kept lemmas or more (2 for trigrams)."""
    often = merged.filter(F.col("n") > above)
    found = lemmatised(often, lemmatise, keep).filter(F.size("lemmas") >= least_lemmas)
    return often.join(found, "ngram").select("ngram", F.array_join("lemmas", " ").alias("lemmata"), "n")


def sorted_lemmata(lemmas) -> F.Column:
    """Lemmas cleaned of all but letters and digits, in order, joined; what is empty then is dropped."""
    return F.array_join(F.array_sort(F.filter(F.transform(lemmas, T.clean_token), lambda w: w != "")), " ")


def documents_to_lemmata(rows: DataFrame, dictionary: DataFrame, lemmatise: Lemmatiser | None = None, keep: Iterable[str] = KEPT) -> DataFrame:
    """``id_kase, lemmata, n``: the bags of documents ``id_kase, ngram, n`` with lemmata in place of n-grams, equal ones summed.

    N-grams that the dictionary lacks go to ``lemmatise`` if there is one (each distinct one once), else they are
    dropped, as are those without a lemma.
    """
    known = dictionary.select("ngram", sorted_lemmata(F.split("lemmata", " ")).alias("lemmata"))
    if lemmatise is not None:
        missing = rows.select("ngram").join(known.select("ngram"), "ngram", "left_anti")
        known = known.unionByName(lemmatised(missing, lemmatise, keep).select("ngram", sorted_lemmata(F.col("lemmas")).alias("lemmata")))
    found = rows.join(known, "ngram").filter("lemmata <> ''")
    return bags.merge(found, "lemmata", ["id_kase"])


def cleaned_vocabulary(merged: DataFrame, stopwords: list[str], shortest: int = 3, short_kept: Iterable[str] = ("Ps", "Mt", "Mk", "Jn")) -> DataFrame:
    """``ngram, n``: a vocabulary after all steps of cleaning.

    Other than ASCII characters and digits stripped, words replaced, whole collocations merged, counts given to each
    distinct word, stop words in three cases and short words deleted, case variants merged.
    """
    text = T.replaced_whole(T.replaced_words(T.strip_digits(T.ascii_only("ngram"))))
    words = bags.spread_to_words(merged.select(text.alias("ngram"), "n"))
    dropped = [v for w in stopwords for v in dict.fromkeys((w, w.capitalize(), w.upper()))]
    long = (F.length("ngram") >= shortest) | F.col("ngram").isin(list(short_kept))
    return bags.case_variants_merged(words.filter(~F.col("ngram").isin(dropped) & long))
