"""Statistics over articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexichron.functions.periods import halfdecade_of, midpoint_of, period_of, period_table
from lexichron.functions.predicate import predicate
from lexichron.operators import metadata as M
from lexichron.operators.numbering import numbered
from lexichron.plans.common import ARTICLES, articles, rounded
from lexichron.session import table

EDGES = list(range(1900, 2021, 10))

QUERIES = {
    "journal_counts": lambda s, d: M.counts(articles(s, d), "isPartOf"),
    "journal_year_stats": lambda s, d: M.range_stats(articles(s, d), "isPartOf", "publicationYear").withColumn("mean", rounded("mean")),
    "journal_counts_with_doi": lambda s, d: M.counts(articles(s, d).filter("doi is not null"), "isPartOf"),
    "decade_counts": lambda s, d: M.counts(articles(s, d), "dec"),
    "decade_sums": lambda s, d: M.sums(articles(s, d), "dec", ["wordCount", "pageCount"]),
    "bidecade_summary": lambda s, d: M.sums(articles(s, d), "period", ["wordCount", "pageCount"]),
    "decade_means": lambda s, d: M.means(articles(s, d), "dec", ["wordCount", "pageCount"]).select(
        "dec", rounded("mean_wordCount").alias("mean_wordCount"), rounded("mean_pageCount").alias("mean_pageCount")
    ),
    "decade_means_numeric": lambda s, d: _mean_numeric(s, d),
    "decade_histogram": lambda s, d: M.histogram(articles(s, d), "y", EDGES),
    "global_metadata_totals": lambda s, d: M.totals(articles(s, d), "wordCount").withColumn("mean", rounded("mean")),
    "english_only_count": lambda s, d: articles(s, d)
    .filter(F.array_contains("language", "eng") & (F.size("language") == 1))
    .agg(F.count("*").alias("n")),
    "masked_word_sum": lambda s, d: articles(s, d).agg(
        F.coalesce(F.sum(F.when(F.col("y") >= 1950, F.col("wordCount"))), F.lit(0)).alias("words"), F.count_if(F.col("y") >= 1950).alias("n")
    ),
    "distinct_doc_types": lambda s, d: articles(s, d).select("docType").distinct().filter("docType is not null"),
    "halfdecade_orders": lambda s, d: table(s, d, "orders")
    .withColumn("period", halfdecade_of(F.year("o_orderdate")))
    .filter("period is not null")
    .groupBy("period")
    .agg(F.count("*").alias("n"), midpoint_of(F.min("period"), 5).alias("midpoint")),
    "generation_orders": lambda s, d: table(s, d, "orders")
    .withColumn("period", period_of(F.year("o_orderdate"), 20, 1900, 2019))
    .groupBy("period")
    .agg(F.count("*").alias("n")),
    "period_dimension": lambda s, d: period_table(s, 20, 1900, 2019),
    "predicate_eq": lambda s, d: articles(s, d).filter(predicate("publicationYear", "==1951")).select("id_kase"),
    "predicate_between": lambda s, d: articles(s, d).filter(predicate("publicationYear", ".between(1950,1959)")).select("id_kase"),
    "predicate_isin": lambda s, d: articles(s, d).filter(predicate("docType", ".isin(['article', 'book'])")).select("id_kase"),
    "predicate_missing": lambda s, d: articles(s, d).filter(predicate("doi", ".isnull()")).select("id_kase"),
    "drop_last": lambda s, d: _drop_last(M.counts(articles(s, d), "dec")),
    "dense_row_ids": lambda s, d: _dense(articles(s, d)),
}


def _mean_numeric(s, d):
    """The mean of every numeric column of the articles, by decade."""
    found = articles(s, d)
    numeric = [c for c, kind in found.dtypes if kind in ("int", "bigint", "double") and c not in ("id_kase", "dec")]
    means = M.means(found, "dec", numeric)
    return means.select("dec", *[rounded(f"mean_{c}").alias(f"mean_{c}") for c in numeric])


def _drop_last(counts):
    last = counts.agg(F.max("dec").alias("last"))
    return counts.join(F.broadcast(last), F.col("dec") < F.col("last")).select("dec", "n")


def _dense(found):
    return numbered(found.select("id_kase"), ["id_kase"]).select("row_id", "id_kase")


def _sql(body: str) -> str:
    return f"WITH {ARTICLES} {body}"


SQL = {
    "journal_counts": _sql("SELECT isPartOf, count(*) AS n FROM articles WHERE isPartOf IS NOT NULL GROUP BY 1"),
    "journal_year_stats": _sql(
        """SELECT isPartOf, count(*) AS n, round(avg(publicationYear), 6) AS mean, min(publicationYear) AS least,
        max(publicationYear) AS greatest FROM articles WHERE isPartOf IS NOT NULL GROUP BY 1"""
    ),
    "journal_counts_with_doi": _sql("SELECT isPartOf, count(*) AS n FROM articles WHERE isPartOf IS NOT NULL AND doi IS NOT NULL GROUP BY 1"),
    "decade_counts": _sql("SELECT dec, count(*) AS n FROM articles WHERE dec IS NOT NULL GROUP BY 1"),
    "decade_sums": _sql(
        """SELECT dec, count(*) AS n, coalesce(sum(wordCount), 0)::BIGINT AS "sum_wordCount", coalesce(sum(pageCount), 0)::BIGINT AS "sum_pageCount"
        FROM articles WHERE dec IS NOT NULL GROUP BY 1"""
    ),
    "bidecade_summary": _sql(
        """SELECT period, count(*) AS n, coalesce(sum(wordCount), 0)::BIGINT AS "sum_wordCount", coalesce(sum(pageCount), 0)::BIGINT AS "sum_pageCount"
        FROM articles WHERE period IS NOT NULL GROUP BY 1"""
    ),
    "decade_means": _sql(
        """SELECT dec, round(avg(wordCount), 6) AS "mean_wordCount", round(avg(pageCount), 6) AS "mean_pageCount" FROM articles
        WHERE dec IS NOT NULL GROUP BY 1"""
    ),
    "decade_means_numeric": _sql(
        "SELECT dec, "
        + ", ".join(f'round(avg({c}), 6) AS "mean_{c}"' for c in ("publicationYear", "pageCount", "wordCount", "year", "decade", "y"))
        + " FROM articles WHERE dec IS NOT NULL GROUP BY 1"
    ),
    "decade_histogram": _sql(
        """SELECT least((floor(y / 10.0) * 10)::INTEGER, 2010) AS bin_start, count(*) AS n FROM articles WHERE y BETWEEN 1900 AND 2020 GROUP BY 1"""
    ),
    "global_metadata_totals": _sql(
        """SELECT count(*) AS n, coalesce(sum(wordCount), 0)::BIGINT AS total, round(avg(wordCount), 6) AS mean, min(wordCount) AS least,
        max(wordCount) AS greatest FROM articles"""
    ),
    "english_only_count": _sql("SELECT count(*) AS n FROM articles WHERE list_contains(language, 'eng') AND len(language) = 1"),
    "masked_word_sum": _sql("SELECT coalesce(sum(wordCount) FILTER (y >= 1950), 0)::BIGINT AS words, count(*) FILTER (y >= 1950) AS n FROM articles"),
    "distinct_doc_types": _sql('SELECT DISTINCT docType AS "docType" FROM articles WHERE docType IS NOT NULL'),
    "halfdecade_orders": """SELECT concat(s, '-', s + 4) AS period, count(*) AS n, (s + 2)::INTEGER AS midpoint FROM (
        SELECT (1990 + floor((year(o_orderdate) - 1990) / 5.0) * 5)::INTEGER AS s FROM orders WHERE year(o_orderdate) BETWEEN 1990 AND 2019) GROUP BY s""",
    "generation_orders": """SELECT CASE WHEN y BETWEEN 1900 AND 2019 THEN concat((1900 + floor((y - 1900) / 20.0) * 20)::INTEGER, '-',
        (1919 + floor((y - 1900) / 20.0) * 20)::INTEGER) END AS period, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1""",
    "period_dimension": "SELECT bidecade AS label, start_year, end_year, (start_year + 10)::INTEGER AS midpoint FROM bidecades",
    "predicate_eq": _sql("SELECT id_kase FROM articles WHERE publicationYear = 1951"),
    "predicate_between": _sql("SELECT id_kase FROM articles WHERE publicationYear BETWEEN 1950 AND 1959"),
    "predicate_isin": _sql("SELECT id_kase FROM articles WHERE docType IN ('article', 'book')"),
    "predicate_missing": _sql("SELECT id_kase FROM articles WHERE doi IS NULL"),
    "drop_last": _sql(
        "SELECT dec, n FROM (SELECT dec, count(*) AS n, max(dec) OVER () AS last FROM articles WHERE dec IS NOT NULL GROUP BY dec) WHERE dec < last"
    ),
    "dense_row_ids": _sql("SELECT (row_number() OVER (ORDER BY id_kase) - 1)::BIGINT AS row_id, id_kase FROM articles"),
}
