"""What the plans share: tables, and the SQL of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.functions.periods import bidecade_of, decade_of, year_of
from lexichron.operators import corpus
from lexichron.session import table


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the periods derived from their dates."""
    year = year_of("datePublished")
    dated = corpus.articles(table(spark, d, "metadata_df")).withColumn("y", year)
    return dated.withColumn("dec", decade_of("y")).withColumn("period", bidecade_of("y"))


def bag(spark: SparkSession, d: str) -> DataFrame:
    return corpus.bag(table(spark, d, "unigrams_lemmata_dict"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def dated_bag(spark: SparkSession, d: str) -> DataFrame:
    """Counts with the decade and the period of their article."""
    return bag(spark, d).join(articles(spark, d).select("id_kase", "y", "dec", "period"), "id_kase")


def rounded(column: str | object, digits: int = 6):
    return F.round(column, digits)


ARTICLES = """
articles0 AS (
  SELECT *, TRY_CAST(split_part(datePublished, '-', 1) AS INTEGER) AS y FROM (
    SELECT *, row_number() OVER (PARTITION BY id_kase ORDER BY ingested_at DESC NULLS LAST) AS rn
    FROM metadata_df WHERE id_kase IS NOT NULL) WHERE rn = 1
), articles AS (
  SELECT *, (floor(y / 10.0) * 10)::BIGINT AS dec,
    CASE WHEN y BETWEEN 1900 AND 2019 THEN
      concat((1900 + floor((y - 1900) / 20.0) * 20)::INTEGER, '-', (1919 + floor((y - 1900) / 20.0) * 20)::INTEGER) END AS period
  FROM articles0
)"""
BAG = """
bag AS (
  SELECT id_kase, ngram, l.l AS lemmata, r.c AS n FROM (
    SELECT id_kase, ngram, max({'t': loaded_at, 'l': lemmata}) AS l, max({'t': loaded_at, 'c': count}) AS r
    FROM unigrams_lemmata_dict WHERE id_kase IS NOT NULL AND ngram IS NOT NULL GROUP BY 1, 2) WHERE r.c > 0
)"""
TOKENS = r"""
tokens AS (
  SELECT doc_id, id_kase, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS tokens FROM documents WHERE text IS NOT NULL
)"""
