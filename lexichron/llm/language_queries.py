"""Queries over languages of texts (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm.languages import UNDETERMINED, fitted_segments, main_languages, named_languages
from lexichron.llm.sentences import learned_abbreviations
from lexichron.session import table


def _segments(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return fitted_segments(documents, table(spark, sf_dir, "lang_labels"), learned_abbreviations(documents), keep)


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document in one language, with a confidence."""
    return _segments(spark, sf_dir)


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of each document, with a confidence."""
    return main_languages(p5_segments(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of whole sentences of each document that its article's labels don't name."""
    held = _segments(spark, sf_dir, ("id_kase",)).filter(F.col("lang") != UNDETERMINED).select("doc_id", "id_kase", "lang").distinct()
    named = named_languages(table(spark, sf_dir, "metadata_df"), table(spark, sf_dir, "lang_labels"))
    return held.join(named, ["id_kase", "lang"], "left_anti").select("doc_id", "lang")


def p5_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that each article's labels name."""
    return named_languages(table(spark, sf_dir, "metadata_df"), table(spark, sf_dir, "lang_labels"))


QUERIES = {"p5_named": p5_named, "p5_found": p5_found, "p5_segments": p5_segments, "p5_documents": p5_documents}
#: No SQL judges languages; it reads labels.
SQL = {
    "p5_named": r"""WITH elements AS (SELECT id_kase, unnest(language) AS e FROM metadata_df WHERE id_kase IS NOT NULL),
      parts AS (SELECT id_kase, lower(regexp_replace(unnest(regexp_split_to_array(e, '[;/]')), '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g')) AS label FROM elements)
      SELECT DISTINCT id_kase, l.lang FROM parts JOIN lang_labels l ON lower(trim(l.label)) = parts.label"""
}
