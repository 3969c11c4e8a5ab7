"""Term matrices over periods, association ranks, vectors, topics.

A line is a sentence-like stretch of a document between line breaks or full
stops; its weight is how often it occurs in the period.  The vocabulary is every
word.  Vectors of the embeddings are grouped by their label, as those of the
reference by period.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexichron.functions import text as T
from lexichron.functions.periods import period_of
from lexichron.operators import matrix as M
from lexichron.operators import topics, vectors
from lexichron.plans.common import ARTICLES, articles, documents
from lexichron.session import table, written

#: Words whose columns are ranked.
FOLLOWED = ["covenant", "letter"]
#: Words between which scores are filled up.
CHOSEN = ["covenant", "letter", "law", "grace", "scribe", "hymn"]
LINE_SPLIT = r"[.!?\n]+"
#: Targets of the ego networks.
TARGETS = [1, 2, 3, 5, 8, 13]


def _each_line(s, d, period="period", white_space=False):
    """``period, line``: every line as often as it occurs, as its tokens, or as its words between white space."""
    found = articles(s, d).withColumn("half", period_of("y", 5, 1900, 2019))
    periods = found.filter(F.col(period).isNotNull()).select("id_kase", F.col(period).alias("period"))
    text = documents(s, d).filter("text is not null").join(periods, "id_kase")
    each = text.select("period", F.explode(F.split("text", LINE_SPLIT)).alias("line"))
    words = T.words if white_space else T.tokens
    return each.select("period", F.array_join(words(F.lower("line")), " ").alias("line")).filter("line <> ''")


def _lines(s, d, **how):
    return _each_line(s, d, **how).groupBy("period", "line").agg(F.count("*").alias("w"))


def _line_terms(s, d, **how):
    found = M.line_terms(_lines(s, d, **how), None, F.split("line", " "))
    return written(found.withColumn("line", F.monotonically_increasing_id()), "line-terms")  # from here on a number stands for the line


def _vocabulary(line_terms):
    return line_terms.select(F.explode("terms.term").alias("term")).distinct()


def _counts(s, d):
    rows = _line_terms(s, d).select("period", "line", "w", F.explode("terms").alias("t"))
    return M.cooccurrence(rows.select("period", "line", "w", "t.term", F.col("t.tf").alias("value")))


def _weights(s, d, **how):
    return M.cooccurrence(M.tfidf(_line_terms(s, d, **how)))


def _r(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _lines_out(s, d, normalise):
    """Per period and term: how many weighted lines hold it, and the sum of its values. By hand, words are what stands between white space."""
    values = M.tfidf(_line_terms(s, d, white_space=not normalise), normalise)
    return _r(values.groupBy("period", "term").agg(F.sum("w").alias("lines"), F.sum(F.col("w") * F.col("value")).alias("total")), "total")


def _ranks(s, d, **how):
    found = _line_terms(s, d, **how)
    return M.association_ranks(M.cooccurrence(M.tfidf(found)), _vocabulary(found), FOLLOWED).withColumn("rank", F.col("rank").cast("bigint"))


def _rank_series(s, d, **how):
    """The place of one word in the column of another, period by period."""
    return _ranks(s, d, **how).filter((F.col("col") == FOLLOWED[1]) & (F.col("row") == FOLLOWED[0])).select("period", "rank")


def _pmi_filled(s, d):
    return _r(M.filled(M.pmi_normalised(M.pmi_k(_counts(s, d))), CHOSEN), "value")


def _dense(s, d):
    tokens = documents(s, d).filter("text is not null").select("doc_id", F.explode(T.tokens(F.lower("text"))).alias("term"), F.lit(1).alias("n"))
    return M.dense(tokens, "doc_id", CHOSEN)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"), "label")


def _hundredth(s, d):
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(s, d).filter("word % 100 = 0").select("word")


def _pairs(s, d):
    """Every vector beside the next one."""
    return _vectors(s, d).select(F.col("word").alias("a"), (F.col("word") + 1).alias("b"))


def _scaled(s, d):
    """Every dimension scaled over all vectors."""
    each = _vectors(s, d).select("word", F.posexplode("vec").alias("dimension", "x"))
    ends = each.groupBy("dimension").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))  # a row per dimension
    x = F.coalesce(F.try_divide(F.col("x").cast("double") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return each.join(F.broadcast(ends), "dimension").select("word", "dimension", F.round(x, 6).alias("x"))


def _grouped_vectors(s, d):
    return _vectors(s, d).withColumnRenamed("label", "period")


def _neighbour_columns(s, d):
    """The 20 nearest words of one word in each group, a column for each group."""
    found = vectors.neighbours(s.createDataFrame([(0,)], "word bigint"), _grouped_vectors(s, d), 20, by="period", anywhere=True)
    return vectors.as_columns(found, "period", list(range(10)))


def _grouped_pairs(s, d):
    """Similarity of one vector with the first of each group, group by group."""
    firsts = _grouped_vectors(s, d).groupBy("period").agg(F.min("word").alias("b"))
    pairs = firsts.select("period", F.lit(0).cast("bigint").alias("a"), "b")
    return _r(vectors.pair_similarity(pairs, _vectors(s, d), keep=["period"]), "similarity")


def _grouped_egos(s, d):
    return vectors.ego_edges_per(0, TARGETS, _grouped_vectors(s, d), "period")


def _subgraph(s, d):
    edges = vectors.ego_edges(0, TARGETS, _vectors(s, d))
    return vectors.subgraph(edges, [0, 1, 2, 3])


def _topic_documents(s, d):
    each = documents(s, d).filter("text is not null").select("doc_id", "id_kase", "source", F.filter(T.tokens(F.lower("text")), lambda w: F.length(w) > 3).alias("tokens"))
    return written(each.filter(F.size("tokens") > 0), "topic-documents")


def _topic_means(s, d):
    docs = _topic_documents(s, d)
    counter, model = topics.fit(docs)
    return _r(topics.means(topics.distributions(docs, counter, model), "source"), "share")


def _topic_decades(s, d):
    """Mean share of each topic in each decade of the articles."""
    docs = _topic_documents(s, d)
    decades = articles(s, d).select("id_kase", "dec")
    counter, model = topics.fit(docs)
    return _r(topics.means(topics.distributions(docs, counter, model).join(decades, "id_kase"), "dec"), "share")


def _topic_words(s, d):
    return topics.topic_words(*topics.fit(_topic_documents(s, d)))


def _term_topics(s, d):
    return topics.term_topics(*topics.fit(_topic_documents(s, d)))


def _coherence(s, d):
    docs = _topic_documents(s, d)
    return _r(topics.coherence(docs, topics.topic_words(*topics.fit(docs)), "source"), "coherence")


def _trained(s, d):
    """Neighbours by vectors of each period."""
    found = written(vectors.train_per(_lines(s, d), "period"), "word-vectors")
    return vectors.neighbours(s.createDataFrame([(w,) for w in FOLLOWED], "word string"), found, 10, by="period")


QUERIES = {
    "count_cooc_by_bidecade": _counts,
    "cooc_diagonal": lambda s, d: _counts(s, d).filter("row = col").select("period", F.col("row").alias("term"), "value"),
    "cooc_transposed": lambda s, d: M.transposed(_counts(s, d).filter(F.col("row").isin(CHOSEN))),
    "pmi_k": lambda s, d: _r(M.pmi_k(_counts(s, d)), "pmi"),
    "pmi_normalised": lambda s, d: _r(M.pmi_normalised(M.pmi_k(_counts(s, d))), "value"),
    "pmi_filled": _pmi_filled,
    "dense_frame": _dense,
    "tfidf_manual": lambda s, d: _lines_out(s, d, False),
    "tfidf_l2": lambda s, d: _lines_out(s, d, True),
    "tfidf_cooc_by_bidecade": lambda s, d: _r(_weights(s, d), "value"),
    "tfidf_cooc_by_halfdecade": lambda s, d: _r(_weights(s, d, period="half"), "value"),
    "cooc_colmax": lambda s, d: _r(M.column_maximum(_weights(s, d)), "value"),
    "assoc_rank": _ranks,
    "assoc_rank_series": _rank_series,
    "assoc_rank_halfdecades": lambda s, d: _rank_series(s, d, period="half"),
    "vector_neighbours": lambda s, d: _r(vectors.neighbours(_hundredth(s, d), _vectors(s, d), 10), "similarity"),
    "pair_similarity": lambda s, d: _r(vectors.pair_similarity(_pairs(s, d), _vectors(s, d)), "similarity"),
    "ego_edges": lambda s, d: vectors.ego_edges(0, TARGETS, _vectors(s, d)),
    "minmax_scale": _scaled,
    "neighbour_columns": _neighbour_columns,
    "pair_similarity_by_group": _grouped_pairs,
    "ego_edges_by_group": _grouped_egos,
    "ego_subgraph": _subgraph,
    "vector_subset": lambda s, d: vectors.subset(_vectors(s, d), _hundredth(s, d)).select("word", "label"),
    "lda_topic_means": _topic_means,
    "lda_topic_decades": _topic_decades,
    "lda_topic_words": _topic_words,
    "lda_term_topics": _term_topics,
    "lda_topic_coherence": _coherence,
    "word2vec_neighbours": _trained,
    "tsne_map": lambda s, d: vectors.mapped(_vectors(s, d)),
    "pca_projection": lambda s, d: vectors.projected(_vectors(s, d)),
}



def _all(period: str = "period", words: str = r"regexp_extract_all(lower(part), '[\p{L}\p{N}_]{2,}')") -> str:
    return rf"""WITH {ARTICLES},
halved AS (SELECT *, CASE WHEN y BETWEEN 1900 AND 2019 THEN concat((floor(y / 5.0) * 5)::INTEGER, '-', (floor(y / 5.0) * 5)::INTEGER + 4) END AS half FROM articles),
lines AS (
  SELECT period, line, count(*) AS w FROM (
    SELECT period, array_to_string({words}, ' ') AS line FROM (
      SELECT a.{period} AS period, unnest(regexp_split_to_array(d.text, '[.!?\n]+')) AS part FROM documents d JOIN halved a USING (id_kase)
      WHERE d.text IS NOT NULL AND a.{period} IS NOT NULL)) WHERE line <> '' GROUP BY 1, 2
), voc AS (SELECT DISTINCT unnest(string_split(line, ' ')) AS term FROM lines
), tf AS (
  SELECT period, line, any_value(w) AS w, term, count(*) AS tf FROM (SELECT period, line, w, unnest(string_split(line, ' ')) AS term FROM lines)
  GROUP BY period, line, term
), sizes AS (SELECT period, sum(w) AS n_lines FROM lines GROUP BY 1
), idf AS (
  SELECT period, term, ln((1.0 + any_value(n_lines)) / (1.0 + sum(w))) + 1 AS idf FROM tf JOIN sizes USING (period) GROUP BY 1, 2
), raw AS (SELECT period, line, w, term, tf * idf AS v FROM tf JOIN idf USING (period, term)
), l2 AS (SELECT period, line, w, term, v / sqrt(sum(v * v) OVER (PARTITION BY period, line)) AS v FROM raw
), cc AS (SELECT a.period, a.term AS row, b.term AS col, sum(a.w * a.tf * b.tf)::BIGINT AS value FROM tf a JOIN tf b
  ON a.period = b.period AND a.line = b.line GROUP BY 1, 2, 3
), tc AS (SELECT a.period, a.term AS row, b.term AS col, sum(a.w * a.v * b.v) AS value FROM l2 a JOIN l2 b
  ON a.period = b.period AND a.line = b.line GROUP BY 1, 2, 3
), pmi AS (SELECT c.period, c.row, c.col, ln(pow(c.value::DOUBLE, 2) / (x.value::DOUBLE * y.value::DOUBLE)) AS pmi FROM cc c
  JOIN cc x ON x.period = c.period AND x.row = c.row AND x.col = c.row JOIN cc y ON y.period = c.period AND y.row = c.col AND y.col = c.col
)"""


_ALL, _HALVES = _all(), _all("half")
_SPACED = _all(words=r"list_filter(regexp_split_to_array(lower(part), '[\t-\r \x{85}\p{Z}]+'), lambda w: w <> '')")


def _ranked(lines: str) -> str:
    return f"""{lines}, filled AS (SELECT p.period, q.col, v.term AS row, round(coalesce(tc.value, 0), 9) AS value
  FROM (SELECT DISTINCT period FROM tc) p CROSS JOIN (SELECT unnest({FOLLOWED}) AS col) q CROSS JOIN voc v
  LEFT JOIN tc ON tc.period = p.period AND tc.col = q.col AND tc.row = v.term),
ranks AS (SELECT period, col, row, row_number() OVER (PARTITION BY period, col ORDER BY value DESC, row) - 1 AS rank FROM filled)"""


_SERIES = f"SELECT period, rank::BIGINT AS rank FROM ranks WHERE col = '{FOLLOWED[1]}' AND row = '{FOLLOWED[0]}'"
_SCALED = """e AS (SELECT period, min(pmi) AS lo, max(pmi) AS hi FROM pmi GROUP BY 1), scaled AS (
        SELECT period, row, col, round(CASE WHEN row = col THEN 1.0 ELSE (pmi - (lo - abs(hi - lo))) / nullif(hi - (lo - abs(hi - lo)), 0) END, 6) AS value
        FROM pmi JOIN e USING (period))"""
_LISTED = "(" + ", ".join(f"'{w}'" for w in CHOSEN) + ")"
_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

SQL = {
    "count_cooc_by_bidecade": f"{_ALL} SELECT period, row, col, value FROM cc",
    "cooc_diagonal": f"{_ALL} SELECT period, row AS term, value FROM cc WHERE row = col",
    "pmi_k": f"{_ALL} SELECT period, row, col, round(pmi, 6) AS pmi FROM pmi",
    "pmi_normalised": f"{_ALL}, {_SCALED} SELECT period, row, col, value FROM scaled",
    "pmi_filled": f"""{_ALL}, {_SCALED} SELECT p.period, a.row, b.col, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT period FROM cc) p
        CROSS JOIN (SELECT unnest({CHOSEN}) AS row) a CROSS JOIN (SELECT unnest({CHOSEN}) AS col) b
        LEFT JOIN scaled s ON s.period = p.period AND s.row = a.row AND s.col = b.col""",
    "cooc_transposed": f"{_ALL} SELECT period, col AS row, row AS col, value FROM cc WHERE row IN {_LISTED}",
    "dense_frame": r"SELECT doc_id, " + ", ".join(f"count(*) FILTER (term = '{w}') AS {w}" for w in CHOSEN)
    + r" FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "tfidf_manual": f"{_SPACED} SELECT period, term, sum(w)::BIGINT AS lines, round(sum(w * v), 6) AS total FROM raw GROUP BY 1, 2",
    "tfidf_l2": f"{_ALL} SELECT period, term, sum(w)::BIGINT AS lines, round(sum(w * v), 6) AS total FROM l2 GROUP BY 1, 2",
    "tfidf_cooc_by_bidecade": f"{_ALL} SELECT period, row, col, round(value, 6) AS value FROM tc",
    "tfidf_cooc_by_halfdecade": f"{_HALVES} SELECT period, row, col, round(value, 6) AS value FROM tc",
    "cooc_colmax": f"{_ALL} SELECT period, row, col, round(value / nullif(max(value) OVER (PARTITION BY period, col), 0), 6) AS value FROM tc",
    "assoc_rank": f"{_ranked(_ALL)} SELECT period, col, row, rank::BIGINT AS rank FROM ranks",
    "assoc_rank_series": f"{_ranked(_ALL)} {_SERIES}",
    "assoc_rank_halfdecades": f"{_ranked(_HALVES)} {_SERIES}",
    "vector_neighbours": f"""SELECT query, word, round(s, 6) AS similarity, rank::INTEGER AS rank FROM (
        SELECT query, word, s, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, word) AS rank FROM (
          SELECT a.vec_id AS query, b.vec_id AS word, {_COSINE} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE a.vec_id % 100 = 0)) WHERE rank <= 10""",
    "pair_similarity": f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b
        ON b.vec_id = a.vec_id + 1""",
    "ego_edges": f"""WITH s AS (SELECT b.vec_id AS dst, {_COSINE} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0),
        m AS (SELECT avg(sim) AS mean FROM (SELECT sim FROM s ORDER BY sim DESC LIMIT 10))
        SELECT 0::BIGINT AS src, dst, round_even(sim / mean, 2) AS weight FROM s, m WHERE dst IN (1, 2, 3, 5, 8, 13)""",
    "minmax_scale": """SELECT word, dimension, round(coalesce((x - lo) / nullif(hi - lo, 0), 0), 6) AS x FROM (
        SELECT word, dimension, x, min(x) OVER (PARTITION BY dimension) AS lo, max(x) OVER (PARTITION BY dimension) AS hi FROM (
          SELECT vec_id AS word, (unnest(range(1, len(embedding) + 1)) - 1)::INTEGER AS dimension, unnest(embedding)::DOUBLE AS x FROM embeddings))""",
    "neighbour_columns": "SELECT rank, " + ", ".join(f"max(dst) FILTER (label = {k}) AS \"{k}\"" for k in range(10)) + f"""
        FROM (SELECT b.label, b.vec_id AS dst, row_number() OVER (PARTITION BY b.label ORDER BY round({_COSINE}, 9) DESC, b.vec_id)::INTEGER AS rank
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0) WHERE rank <= 20 GROUP BY 1""",
    "pair_similarity_by_group": f"""SELECT b.label AS period, a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b
        ON b.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label) WHERE a.vec_id = 0""",
    "ego_edges_by_group": f"""WITH s AS (SELECT b.label AS period, b.vec_id AS dst, {_COSINE} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0),
        m AS (SELECT period, avg(sim) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(sim, 9) DESC, dst) AS rn FROM s) WHERE rn <= 10 GROUP BY 1)
        SELECT period, 0::BIGINT AS src, dst, round_even(sim / mean, 2) AS weight FROM s JOIN m USING (period) WHERE dst IN (1, 2, 3, 5, 8, 13)""",
    "ego_subgraph": f"""WITH s AS (SELECT b.vec_id AS dst, {_COSINE} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id = 0),
        m AS (SELECT avg(sim) AS mean FROM (SELECT sim FROM s ORDER BY sim DESC LIMIT 10))
        SELECT 0::BIGINT AS src, dst, round_even(sim / mean, 2) AS weight FROM s, m WHERE dst IN (1, 2, 3)""",
    "vector_subset": "SELECT vec_id AS word, label FROM embeddings WHERE vec_id % 100 = 0",
}
