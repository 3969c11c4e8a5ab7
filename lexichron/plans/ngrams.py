"""N-gram bags: merging, ranking, frequencies, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.functions.predicate import predicate
from lexichron.functions.snowball import snowball_stem
from lexichron.operators import bags as B
from lexichron.operators import corpus, vocabulary
from lexichron.plans.common import ARTICLES, BAG, TOKENS, articles, bag, dated_bag, documents, rounded
from lexichron.session import written
from lexichron.sources.writers import repeated_lines

PERIODS = ["1900-1919", "1920-1939", "1940-1959", "1960-1979", "1980-1999", "2000-2019"]
#: Words followed over time.
WORDS = ["letter", "Letter", "history", "covenant", "nowhere"]
#: Words that tell nothing by themselves.
STOPS = "the of and to in a is was that for it with as by on not his be at from are this have an had or were which".split()
LATIN_STOPS = "et in est ad ut non cum de ex quae the and".split()
LEAST = 20


def _fifties(s, d):
    return B.of_documents(bag(s, d), articles(s, d).filter(predicate("publicationYear", ".between(1950,1959)")))


def _not_stop(df, key="ngram"):
    return df.filter(~F.lower(key).isin(STOPS))


def _ngram_top(s, d, n):
    rows = corpus.document_ngrams(documents(s, d), n).groupBy("ngram").agg(F.count("*").alias("n"))
    return B.top(_not_stop(rows), 25)


def _tokens(s, d):
    each = corpus.document_tokens(documents(s, d)).select("doc_id", "id_kase", F.explode("tokens").alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def _series(s, d):
    totals = articles(s, d).filter("period is not null").groupBy("period").agg(F.sum("wordCount").alias("total"))
    rows = B.merge(dated_bag(s, d).filter("period is not null"), by=["period"])
    return rows, totals


def _pct_decade(s, d):
    totals = articles(s, d).filter("dec is not null").groupBy("dec").agg(F.sum("wordCount").alias("total"))
    rows = B.merge(dated_bag(s, d).filter("dec is not null"), by=["dec"])
    return B.percentages(rows, totals, "dec", WORDS).withColumn("pct", rounded("pct"))


def _shares(s, d):
    """``period, ngram, f``: relative frequencies of all n-grams."""
    rows, totals = _series(s, d)
    return rows.join(F.broadcast(totals), "period").select("period", "ngram", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("f"))


def _freq_bidecade(s, d):
    return _shares(s, d).select("period", "ngram", rounded("f", 9).alias("freq"))


def _mean_freq(s, d):
    return _shares(s, d).groupBy("ngram").agg(rounded(F.sum("f") / len(PERIODS), 9).alias("mean_freq"))


def _zero_filled(s, d):
    rows, totals = _series(s, d)
    words = s.createDataFrame([(w,) for w in WORDS], "ngram string")
    scaffold = totals.select("period").crossJoin(F.broadcast(words))  # both sides are settings
    return scaffold.join(rows, ["period", "ngram"], "left").select("period", "ngram", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _two_rounds(s, d):
    rows = bag(s, d)
    sample = articles(s, d).filter("publicationYear < 1980").select("id_kase")
    return B.two_rounds(rows, sample, LEAST)


def _case_variants(s, d):
    return B.case_variants_merged(B.merge(bag(s, d)))


def _plurals(s, d):
    merged = B.merge(bag(s, d).withColumn("ngram", F.lower("ngram")))
    base = merged.select(F.concat("ngram", F.lit("s")).alias("ngram"), F.col("ngram").alias("singular"), F.col("n").alias("n_singular"))
    return merged.join(base, "ngram").select("singular", F.col("ngram").alias("plural"), "n_singular", F.col("n").alias("n_plural"))


def _deleted(s, d):
    """Stop words deleted as they are, capitalised and in capitals."""
    words = s.createDataFrame([(v,) for w in STOPS for v in dict.fromkeys((w, w.capitalize(), w.upper()))], "ngram string")
    return B.without(B.merge(bag(s, d)), F.broadcast(words))


def _lemmas(s, d):
    """One lemma per n-gram: its most frequent, of equal ones the least."""
    counted = bag(s, d).filter("trim(lemmata) <> ''").groupBy("ngram", "lemmata").agg(F.sum("n").alias("n"))
    return counted.groupBy("ngram").agg(F.min(F.struct((-F.col("n")).alias("o"), "lemmata"))["lemmata"].alias("lemmata"))


def _lemma_inner(s, d):
    return B.merge(B.merge(bag(s, d)).join(_lemmas(s, d), "ngram").select("lemmata", "n"), "lemmata")


def _lemma_fallback(s, d):
    joined = B.merge(bag(s, d)).join(_lemmas(s, d), "ngram", "left")
    return B.merge(joined.select(F.coalesce("lemmata", F.lower("ngram")).alias("lemmata"), "n"), "lemmata")


def _overwrite(s, d):
    """Counts of the years from 1980 over those before, n-gram by n-gram: the later side stands where both have one."""
    rows = bag(s, d).join(articles(s, d).select("id_kase", "publicationYear"), "id_kase")
    old = B.merge(rows.filter("publicationYear < 1980")).withColumnRenamed("n", "old")
    new = B.merge(rows.filter("publicationYear >= 1980")).withColumnRenamed("n", "new")
    return old.join(new, "ngram", "full_outer").select("ngram", F.coalesce("new", "old").alias("n"))


def _dictionary(s, d):
    return vocabulary.dictionary(_tokens(s, d), LEAST)


def _bow(s, d, least=1):
    tokens = written(_tokens(s, d), "tokens")
    bow = vocabulary.bag_of_words(tokens, vocabulary.dictionary(tokens, LEAST)).filter(F.size("bow") > least - 1)
    return bow.select("doc_id", F.concat_ws(" ", F.transform("bow", lambda x: F.concat_ws(":", x["token_id"], x["n"]))).alias("bow"))


#: Lines of a sample.
SAMPLE_LINES = 1000


def _sampled(s, d):
    """A drawn sample of lines: how many there are, and how many of them stand in the table."""
    lines = written(B.merge(_fifties(s, d)).select(F.col("ngram").alias("line"), F.col("n").alias("w")), "sampled-from")
    drawn = B.sample_lines(lines, SAMPLE_LINES, 1)
    return drawn.join(lines.select("line", F.lit(1).alias("held")), "line", "left").agg(F.count("*").alias("n"), F.count("held").alias("held"))


QUERIES = {
    "bag_merge": lambda s, d: B.merge(_fifties(s, d)),
    "top_unigrams": lambda s, d: B.top(_not_stop(B.merge(_fifties(s, d))), 10),
    "top_bigrams": lambda s, d: _ngram_top(s, d, 2),
    "top_trigrams": lambda s, d: _ngram_top(s, d, 3),
    "top_per_decade": lambda s, d: B.top_per(_not_stop(B.merge(dated_bag(s, d).filter("dec is not null"), by=["dec"])), "dec", 10),
    "offset_skip": lambda s, d: B.top(B.merge(bag(s, d)), 10, skip=10),
    "ngram_threshold_counts": lambda s, d: B.merge(bag(s, d)).filter(F.col("n") > LEAST),
    "ngram_length_profile": lambda s, d: B.merge(bag(s, d)).groupBy(F.length("ngram").alias("chars")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")),
    "types_tokens_coverage": lambda s, d: B.coverage(B.merge(bag(s, d)), [1, 2, 5, 10, 50, 100]).withColumn("pct_kept", rounded("pct_kept")),
    "pct_frequency_by_decade": _pct_decade,
    "freq_by_bidecade": _freq_bidecade,
    "mean_freq_ranking": _mean_freq,
    "term_series_zero_filled": _zero_filled,
    "vocab_period_pivot": lambda s, d: B.pivoted(_series(s, d)[0], PERIODS),
    "two_round_keys": _two_rounds,
    "case_variant_merge": _case_variants,
    "plural_candidates": _plurals,
    "delete_keys": _deleted,
    "stopwords_union": lambda s, d: s.createDataFrame([(w,) for w in STOPS], "word string").union(s.createDataFrame([(w,) for w in LATIN_STOPS], "word string")).distinct(),
    "vocab_subtract": lambda s, d: bag(s, d).select("ngram").subtract(_fifties(s, d).select("ngram")),
    "bag_union_all": lambda s, d: B.merge(_fifties(s, d).select("ngram", "n").unionByName(bag(s, d).select("ngram", "n"))),
    "lemma_lookup_inner": _lemma_inner,
    "lemma_lookup_fallback": _lemma_fallback,
    "map_overwrite_merge": _overwrite,
    "distinct_word_distribution": lambda s, d: B.spread_to_words(corpus.document_ngrams(documents(s, d), 3).groupBy("ngram").agg(F.count("*").alias("n"))),
    "doc_frequency": lambda s, d: vocabulary.document_frequency(_tokens(s, d)),
    "dictionary_ids": _dictionary,
    "doc2bow": _bow,
    "bow_min_two": lambda s, d: _bow(s, d, 2),
    "semi_join_docs": lambda s, d: documents(s, d).join(articles(s, d).filter("y >= 1950"), "id_kase", "left_semi").select("doc_id"),
    "anti_join_docs": lambda s, d: documents(s, d).join(articles(s, d), "id_kase", "left_anti").select("doc_id"),
    "point_lookup": lambda s, d: B.merge(bag(s, d).filter(F.col("ngram") == "covenant")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")),
    "capitalised_keys": lambda s, d: B.merge(bag(s, d).filter(F.col("ngram").rlike(r"^\p{Lu}"))),
    "prefix_keys": lambda s, d: B.merge(bag(s, d).filter(F.col("ngram").rlike("^pre"))),
    "weighted_line_export": lambda s, d: _fifties(s, d).groupBy("ngram").agg(F.sum("n").alias("w")).select(F.col("ngram").alias("line"), "w", (F.col("w") * F.length("ngram")).alias("chars")),
    "repeated_lines": lambda s, d: repeated_lines(_fifties(s, d).groupBy(F.col("ngram").alias("line")).agg(F.sum("n").alias("w"))).groupBy("line").agg(F.count("*").alias("n")),
    "sampled_lines": _sampled,
    "snowball_counts": lambda s, d: B.merge(B.merge(bag(s, d).withColumn("ngram", F.lower("ngram"))).withColumn("ngram", snowball_stem("ngram"))),
    "text_stem_counts": lambda s, d: B.merge(corpus.document_ngrams(documents(s, d), 2).groupBy("ngram").agg(F.count("*").alias("n")).withColumn("ngram", T.text_stems("ngram"))),
    "stemmed_counts": lambda s, d: B.merge(B.merge(bag(s, d).withColumn("ngram", F.lower("ngram"))).withColumn("ngram", T.porter_stem("ngram"))),
}


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_DATED = "dated AS (SELECT b.*, a.y, a.dec, a.period, a.publicationYear FROM bag b JOIN articles a USING (id_kase))"
#: DuckDB's lower() leaves a final sigma as any other.
_LOW = "regexp_replace(lower(ngram), 'σ$', 'ς')"
_MERGED = "merged AS (SELECT ngram, sum(n)::BIGINT AS n FROM bag GROUP BY 1)"
_FIFTIES = "fifties AS (SELECT b.* FROM bag b JOIN articles a USING (id_kase) WHERE a.publicationYear BETWEEN 1950 AND 1959)"
_SERIES = """series AS (SELECT period, ngram, sum(n)::BIGINT AS n FROM dated WHERE period IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT period, sum(wordCount)::BIGINT AS total FROM articles WHERE period IS NOT NULL GROUP BY 1)"""
_ALL = f"WITH {ARTICLES}, {BAG}, {_DATED}, {_MERGED}, {_FIFTIES}"
_RUNS = """runs AS (SELECT doc_id, list_transform(range(1, len(tokens) - {k} + 2), lambda i: array_to_string(tokens[i:i + {k} - 1], ' ')) AS r FROM tokens),
grams AS (SELECT ngram, count(*) AS n FROM (SELECT unnest(r) AS ngram FROM runs) GROUP BY 1)"""
_TOP_GRAMS = "WITH {tokens}, {runs} SELECT ngram, n FROM grams WHERE lower(ngram) NOT IN {stops} ORDER BY n DESC, ngram LIMIT 25"
_DOCTOK = """doctok AS (SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(tokens) AS token FROM tokens) GROUP BY 1, 2),
dict AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::BIGINT AS token_id, df FROM (
  SELECT token, count(*)::BIGINT AS df FROM doctok GROUP BY 1 HAVING sum(n) >= {least}))""".format(least=LEAST)
_BOW = f"""WITH {TOKENS}, {_DOCTOK} SELECT doc_id, string_agg(concat(token_id, ':', n), ' ' ORDER BY token_id) AS bow
FROM doctok JOIN dict USING (token) GROUP BY 1"""
_LEMMAS = """lemma AS (SELECT ngram, lemmata FROM (
  SELECT *, row_number() OVER (PARTITION BY ngram ORDER BY n DESC, lemmata) AS rn FROM (
    SELECT ngram, lemmata, sum(n) AS n FROM bag WHERE trim(lemmata) <> '' GROUP BY 1, 2)) WHERE rn = 1)"""

SQL = {
    "bag_merge": f"{_ALL} SELECT ngram, sum(n)::BIGINT AS n FROM fifties GROUP BY 1",
    "top_unigrams": f"{_ALL} SELECT ngram, sum(n)::BIGINT AS n FROM fifties WHERE lower(ngram) NOT IN {_list(STOPS)} GROUP BY 1 ORDER BY n DESC, ngram LIMIT 10",
    "top_bigrams": _TOP_GRAMS.format(tokens=TOKENS, runs=_RUNS.format(k=2), stops=_list(STOPS)),
    "top_trigrams": _TOP_GRAMS.format(tokens=TOKENS, runs=_RUNS.format(k=3), stops=_list(STOPS)),
    "top_per_decade": f"""{_ALL} SELECT dec, ngram, n, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY dec ORDER BY n DESC, ngram)::INTEGER AS rank FROM (
          SELECT dec, ngram, sum(n)::BIGINT AS n FROM dated WHERE dec IS NOT NULL AND lower(ngram) NOT IN {_list(STOPS)} GROUP BY 1, 2)) WHERE rank <= 10""",
    "offset_skip": f"{_ALL} SELECT ngram, n FROM merged ORDER BY n DESC, ngram LIMIT 10 OFFSET 10",
    "ngram_threshold_counts": f"{_ALL} SELECT ngram, n FROM merged WHERE n > {LEAST}",
    "ngram_length_profile": f"{_ALL} SELECT length(ngram)::INTEGER AS chars, count(*) AS types, sum(n)::BIGINT AS tokens FROM merged GROUP BY 1",
    "types_tokens_coverage": f"""{_ALL} SELECT threshold, count(*) AS types, sum(n)::BIGINT AS tokens, count(*) FILTER (n >= threshold) AS types_kept,
        coalesce(sum(n) FILTER (n >= threshold), 0)::BIGINT AS tokens_kept, round(coalesce(sum(n) FILTER (n >= threshold), 0) * 100.0 / sum(n), 6)::DOUBLE AS pct_kept
        FROM merged, (SELECT unnest([1, 2, 5, 10, 50, 100])::BIGINT AS threshold) GROUP BY 1""",
    "pct_frequency_by_decade": f"""{_ALL}, total AS (SELECT dec, sum(wordCount) AS total FROM articles WHERE dec IS NOT NULL GROUP BY 1),
        num AS (SELECT dec, ngram, sum(n) AS n FROM dated GROUP BY 1, 2)
        SELECT t.dec, w.ngram, round(coalesce(n.n, 0)::DOUBLE * 100.0 / nullif(t.total, 0)::DOUBLE, 6) AS pct
        FROM total t CROSS JOIN (SELECT unnest({list(WORDS)}) AS ngram) w LEFT JOIN num n ON n.dec = t.dec AND n.ngram = w.ngram""",
    "freq_by_bidecade": f"{_ALL}, {_SERIES} SELECT period, ngram, round(n::DOUBLE / total::DOUBLE, 9) AS freq FROM series JOIN totals USING (period)",
    "mean_freq_ranking": f"{_ALL}, {_SERIES} SELECT ngram, round(sum(n::DOUBLE / total::DOUBLE) / {len(PERIODS)}, 9) AS mean_freq FROM series JOIN totals USING (period) GROUP BY 1",
    "term_series_zero_filled": f"""{_ALL}, {_SERIES} SELECT t.period, w.ngram, coalesce(s.n, 0)::BIGINT AS n FROM totals t
        CROSS JOIN (SELECT unnest({list(WORDS)}) AS ngram) w LEFT JOIN series s ON s.period = t.period AND s.ngram = w.ngram""",
    "vocab_period_pivot": f"{_ALL}, {_SERIES} SELECT ngram, "
    + ", ".join(f"coalesce(sum(n) FILTER (period = '{p}'), 0)::BIGINT AS \"{p}\"" for p in PERIODS)
    + " FROM series GROUP BY 1",
    "two_round_keys": f"""{_ALL}, r AS (SELECT ngram, a.publicationYear IS NOT NULL AND a.publicationYear < 1980 AS early, sum(b.n) AS n
        FROM bag b LEFT JOIN articles a USING (id_kase) GROUP BY 1, 2 HAVING sum(b.n) > {LEAST})
        SELECT ngram, min(CASE WHEN early THEN 1 ELSE 2 END)::INTEGER AS round FROM r GROUP BY 1""",
    "case_variant_merge": f"""{_ALL} SELECT ngram, total AS n FROM (
        SELECT ngram, sum(n) OVER (PARTITION BY {_LOW})::BIGINT AS total,
          row_number() OVER (PARTITION BY {_LOW} ORDER BY n DESC, ngram <> {_LOW}, ngram) AS rn FROM merged) WHERE rn = 1""",
    "plural_candidates": f"""{_ALL}, low AS (SELECT {_LOW} AS g, sum(n)::BIGINT AS n FROM bag GROUP BY 1)
        SELECT a.g AS singular, b.g AS plural, a.n AS n_singular, b.n AS n_plural FROM low a JOIN low b ON b.g = concat(a.g, 's')""",
    "delete_keys": f"{_ALL} SELECT ngram, n FROM merged WHERE ngram NOT IN {_list([v for w in STOPS for v in dict.fromkeys((w, w.capitalize(), w.upper()))])}",
    "stopwords_union": f"SELECT unnest({STOPS}) AS word UNION SELECT unnest({LATIN_STOPS})",
    "vocab_subtract": f"{_ALL} SELECT ngram FROM merged EXCEPT SELECT ngram FROM fifties",
    "bag_union_all": f"{_ALL} SELECT ngram, sum(n)::BIGINT AS n FROM (SELECT ngram, n FROM fifties UNION ALL SELECT ngram, n FROM bag) GROUP BY 1",
    "lemma_lookup_inner": f"{_ALL}, {_LEMMAS} SELECT lemmata, sum(n)::BIGINT AS n FROM merged JOIN lemma USING (ngram) GROUP BY 1",
    "lemma_lookup_fallback": f"{_ALL}, {_LEMMAS} SELECT coalesce(l.lemmata, lower(m.ngram)) AS lemmata, sum(n)::BIGINT AS n FROM merged m LEFT JOIN lemma l USING (ngram) GROUP BY 1",
    "map_overwrite_merge": f"""{_ALL}, old AS (SELECT ngram, sum(n) AS n FROM dated WHERE publicationYear < 1980 GROUP BY 1),
        new AS (SELECT ngram, sum(n) AS n FROM dated WHERE publicationYear >= 1980 GROUP BY 1)
        SELECT coalesce(new.ngram, old.ngram) AS ngram, coalesce(new.n, old.n)::BIGINT AS n FROM old FULL JOIN new ON old.ngram = new.ngram""",
    "distinct_word_distribution": f"""WITH {TOKENS}, {_RUNS.format(k=3)} SELECT ngram, sum(n)::BIGINT AS n FROM (
        SELECT unnest(list_distinct(string_split(ngram, ' '))) AS ngram, n FROM grams) GROUP BY 1""",
    "doc_frequency": f"WITH {TOKENS}, {_DOCTOK} SELECT token, count(*) AS df FROM doctok GROUP BY 1",
    "dictionary_ids": f"WITH {TOKENS}, {_DOCTOK} SELECT token, token_id, df FROM dict",
    "doc2bow": _BOW,
    "bow_min_two": f"{_BOW} HAVING count(*) > 1",
    "semi_join_docs": f"WITH {ARTICLES} SELECT doc_id FROM documents WHERE id_kase IN (SELECT id_kase FROM articles WHERE y >= 1950)",
    "anti_join_docs": f"WITH {ARTICLES} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.id_kase = d.id_kase)",
    "point_lookup": f"{_ALL} SELECT coalesce(max(n) FILTER (ngram = 'covenant'), 0)::BIGINT AS n FROM merged",
    "capitalised_keys": f"{_ALL} SELECT ngram, n FROM merged WHERE regexp_matches(ngram, '^\\p{{Lu}}')",
    "prefix_keys": f"{_ALL} SELECT ngram, n FROM merged WHERE starts_with(ngram, 'pre')",
    "repeated_lines": f"{_ALL} SELECT ngram AS line, sum(n)::BIGINT AS n FROM fifties GROUP BY 1",
    "sampled_lines": f"SELECT {SAMPLE_LINES} AS n, {SAMPLE_LINES} AS held",
    "weighted_line_export": f"{_ALL} SELECT ngram AS line, sum(n)::BIGINT AS w, (sum(n) * length(ngram))::BIGINT AS chars FROM fifties GROUP BY ngram",
}
