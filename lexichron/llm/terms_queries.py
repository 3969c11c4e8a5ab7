"""Queries over counted terms (problems 1, 2 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm.cooccurrence import cooccurring
from lexichron.llm.distinctiveness import distinctiveness, most_distinctive
from lexichron.llm.term_counts import marked, term_counts
from lexichron.llm.terms import counted_terms
from lexichron.session import table, written


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(counted_terms(table(spark, sf_dir, "unigrams_lemmata_dict")), "counted")


def _records(counted: DataFrame) -> int:
    return counted.agg(F.countDistinct("id_kase")).first()[0]


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, its records and its mark."""
    counted = _counted(spark, sf_dir)
    return marked(term_counts(counted), _records(counted))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p1_terms(spark, sf_dir).filter(F.col("mark").isNotNull()).select("term", "mark")


def record_periods(metadata: DataFrame, bidecades: DataFrame) -> DataFrame:
    """``id_kase, bidecade``: each article's bidecade as the table of bidecades writes it.

    Labels that differ only in spaces or in the sort of dash are the same; articles without a known one are left out.
    """
    plain = F.regexp_replace(F.regexp_replace("bidecade", r"[\s\u00a0\u2000-\u200b\u202f\u205f\u3000]+", ""), r"[\p{Pd}\u2212]", "-")
    known = bidecades.select(F.col("bidecade").alias("grp"), plain.alias("label")).distinct()  # six rows, fixed
    delivered = metadata.filter("id_kase is not null and bidecade is not null").select("id_kase", plain.alias("label"))
    return delivered.join(F.broadcast(known), "label").groupBy("id_kase").agg(F.max("grp").alias("grp"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms of the same article, by bidecade, with their counts and lift."""
    periods = record_periods(table(spark, sf_dir, "metadata_df"), table(spark, sf_dir, "bidecades"))
    counted = counted_terms(table(spark, sf_dir, "unigrams_lemmata_dict"))
    rows = written(
        counted.join(periods, "id_kase").select("grp", F.col("id_kase").alias("record"), F.col("term").alias("item")), "record-items"
    )
    return cooccurring(rows, min_count=5, min_share=0.008, min_lift=4.0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select(
        F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"), F.col("grp").alias("bidecade")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic term of each record among terms held by at least two records, in the order that is asked for."""
    return most_distinctive(p6_scores(spark, sf_dir))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and term with both scores: the posterior of the elite class, and TF-IDF."""
    return distinctiveness(_counted(spark, sf_dir), min_records=2)


def p6_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that need no fit."""
    return p6_scores(spark, sf_dir).select("id_kase", "term", "n", "d", "records", F.round("score", 6).alias("score"))


#: DuckDB has no NFKC. These are the compatibility characters the tables use, under NFC.
_COUNTED = """
latest AS (
  SELECT id_kase, ngram, max({'t': loaded_at, 'l': lemmata, 'c': count}) AS r
  FROM unigrams_lemmata_dict WHERE id_kase IS NOT NULL GROUP BY 1, 2
), lemmas AS (
  SELECT id_kase, r.c AS n, regexp_replace(trim(lower(nfc_normalize(regexp_replace(replace(replace(replace(replace(replace(replace(
    r.l, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬆ', 'st'), '^\\s+|\\s+$', '', 'g')))), 'σ($|\\s)', 'ς\\1', 'g') AS term
  FROM latest WHERE r.c > 0 AND r.l IS NOT NULL
), counted AS (
  SELECT id_kase, term, sum(n)::BIGINT AS n FROM lemmas WHERE term <> '' GROUP BY 1, 2
), terms AS (
  SELECT term, sum(n)::BIGINT AS occurrences, count(*)::BIGINT AS records FROM counted GROUP BY 1
), total AS (
  SELECT count(DISTINCT id_kase) AS n_all FROM counted
), marked AS (
  SELECT term, occurrences, records,
    CASE WHEN records < 3 THEN 'rare' WHEN records * 4 > n_all THEN 'common' END AS mark FROM terms, total
)
"""

_PERIODS = """
periods AS (
  SELECT m.id_kase, max(b.bidecade) AS bidecade FROM metadata_df m JOIN bidecades b
    ON regexp_replace(regexp_replace(m.bidecade, '\\s', '', 'g'), '[–—‐‑‒―−]', '-', 'g') = b.bidecade
  WHERE m.id_kase IS NOT NULL GROUP BY 1
), held AS (
  SELECT bidecade, id_kase, term FROM counted JOIN periods USING (id_kase)
), sizes AS (
  SELECT bidecade, count(DISTINCT id_kase) AS n_all FROM held GROUP BY 1
), frequent AS (
  SELECT bidecade, term, count(*) AS n FROM held GROUP BY 1, 2
), kept AS (
  SELECT h.bidecade, h.id_kase, h.term, f.n, s.n_all FROM held h JOIN frequent f USING (bidecade, term)
  JOIN sizes s USING (bidecade) WHERE f.n >= 5 AND f.n * 1000 >= 8 * s.n_all
), pairs AS (
  SELECT a.bidecade, a.term AS term_a, b.term AS term_b, any_value(a.n_all) AS n_all, any_value(a.n) AS n_a,
    any_value(b.n) AS n_b, count(*) AS n_both
  FROM kept a JOIN kept b ON a.bidecade = b.bidecade AND a.id_kase = b.id_kase AND a.term < b.term GROUP BY 1, 2, 3
), cases AS (
  SELECT * FROM pairs WHERE n_both >= 5 AND 1000 * n_both >= 8 * n_all AND n_both * n_all >= 4 * n_a * n_b
)
"""

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_pairs": p2_pairs, "p6_found": p6_found, "p6_scores": p6_scores, "p6_tfidf": p6_tfidf}

SQL = {
    "p1_found": f"WITH {_COUNTED} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": f"WITH {_COUNTED} SELECT term, occurrences, records, mark FROM marked",
    "p2_found": f"WITH {_COUNTED}, {_PERIODS} SELECT term_a, term_b, bidecade FROM cases",
    "p2_pairs": f"""WITH {_COUNTED}, {_PERIODS} SELECT bidecade AS grp, term_a AS item_a, term_b AS item_b, n_all AS records,
  n_a, n_b, n_both, n_both * n_all / (n_a * n_b) AS lift FROM cases""",
    "p6_tfidf": f"""WITH {_COUNTED} SELECT id_kase, term, n, t.records AS d, n_all AS records, round(n * (ln((1.0 + n_all) / (1.0 + t.records)) + 1), 6) AS score
  FROM counted JOIN terms t USING (term), total WHERE t.records >= 2""",
    "p6_found": f"""WITH {_COUNTED}, scored AS (
  SELECT c.id_kase, c.term, round(c.n * (ln((1.0 + n_all) / (1.0 + t.records)) + 1), 9) AS score
  FROM counted c JOIN terms t USING (term), total WHERE t.records >= 2)
SELECT id_kase, term FROM (
  SELECT *, row_number() OVER (PARTITION BY id_kase ORDER BY score DESC, term) AS rn FROM scored) WHERE rn = 1""",
}
