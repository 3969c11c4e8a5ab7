"""Queries over sentences (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm.sentences import learned_abbreviations, sentences
from lexichron.session import table


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document; the abbreviations of the collection are learned first."""
    documents = table(spark, sf_dir, "documents")
    return sentences(documents, learned_abbreviations(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_sentences(spark, sf_dir).select("doc_id", "start_char", "end_char")


def p9_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document with a sentence: the characters other than white space that its sentences hold, and how many begin or end with white space."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    bare = F.regexp_replace(words, _SPACE, "")
    ragged = F.length(F.regexp_replace(words, f"^{_SPACE}|{_SPACE}$", "")) != F.length(words)
    each = p9_sentences(spark, sf_dir).join(documents, "doc_id").select("doc_id", F.length(bare).alias("solid"), ragged.alias("ragged"))
    return each.groupBy("doc_id").agg(F.sum("solid").alias("solid"), F.count_if("ragged").alias("ragged"))


_SPACE = r"[\t-\r\x{1c}-\x{1f} \x{85}\p{Z}]"
QUERIES = {"p9_found": p9_found, "p9_sentences": p9_sentences, "p9_cover": p9_cover}
#: No SQL finds sentences; what must hold of any is that every character lies in exactly one of them.
SQL = {"p9_cover": f"SELECT doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS solid, 0 AS ragged FROM documents WHERE regexp_replace(text, '{_SPACE}', '', 'g') <> ''"}
