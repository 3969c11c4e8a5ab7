"""The corpus as tables: articles, n-gram bags, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.functions import text as T


def articles(metadata: DataFrame) -> DataFrame:
    """One row per article, its latest delivery; rows without a key are left out.

    Of rows delivered at the same time each column takes its greatest value, a null
    time is earlier than any.  Each column is an aggregate of its own, so those that
    nobody asks for are neither read nor moved.  A grouped maximum, so a much
    repeated article is combined before the shuffle.
    """
    columns = [c for c in metadata.columns if c not in ("id_kase", "ingested_at")]
    latest = [F.max(F.struct("ingested_at", c))[c].alias(c) for c in columns]
    return metadata.filter("id_kase is not null").groupBy("id_kase").agg(*latest, F.max("ingested_at").alias("ingested_at"))


def bag(dictionary: DataFrame) -> DataFrame:
    """``id_kase, ngram, lemmata, n``: the n-gram counts of articles, the latest row of each n-gram, positive counts only.

    Of rows loaded at the same time the greatest count and the greatest lemma stand; the lemma is not read unless asked for.
    """
    latest = [F.max(F.struct("loaded_at", c))[c].alias(name) for c, name in (("lemmata", "lemmata"), ("count", "n"))]
    found = dictionary.filter("id_kase is not null and ngram is not null").groupBy("id_kase", "ngram").agg(*latest)
    return found.filter("n > 0")


def document_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, id_kase, tokens``: the tokens of each document, in order."""
    return documents.select("doc_id", "id_kase", T.tokens("text").alias("tokens"))


def document_ngrams(documents: DataFrame, n: int) -> DataFrame:
    """``doc_id, id_kase, ngram``: every run of ``n`` tokens."""
    with_tokens = document_tokens(documents)
    return with_tokens.select("doc_id", "id_kase", F.explode(T.ngrams(F.col("tokens"), n)).alias("ngram"))
