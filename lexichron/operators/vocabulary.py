"""Dictionaries, bags of words, document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.operators.numbering import numbered


def dictionary(rows: DataFrame, least: int = 1, key: str = "token") -> DataFrame:
    """``token, token_id, df``: tokens with a total of ``least`` or more, numbered from 0 in order of the token."""
    kept = rows.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("df")).filter(F.col("n") >= least)
    return numbered(kept.select(F.col(key).alias("token"), "df"), ["token"], "token_id").select("token", "token_id", "df")


def tokens_of(dictionary_: DataFrame, ids: DataFrame) -> DataFrame:
    """``token_id, token`` of the listed ids: the dictionary the other way round; ids that it lacks are left out."""
    return ids.select("token_id").distinct().join(dictionary_.select("token_id", "token"), "token_id")


def bag_of_words(rows: DataFrame, dictionary_: DataFrame, key: str = "token", doc: str = "doc_id") -> DataFrame:
    """``doc, bow``: pairs of token id and count of each document, by id; tokens not in the dictionary are dropped."""
    known = rows.join(dictionary_.select(F.col("token").alias(key), "token_id"), key)
    counted = known.repartition(doc).groupBy(doc, "token_id").agg(F.sum("n").alias("n"))  # one shuffle for both groupings; a document is bounded by its text
    return counted.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("token_id", "n"))).alias("bow"))


def document_frequency(rows: DataFrame, key: str = "token", doc: str = "doc_id") -> DataFrame:
    return rows.select(doc, key).distinct().groupBy(key).agg(F.count("*").alias("df"))
