"""Bags, matrices, vectors and vocabularies on small tables worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lexichron.operators import bags as B
from lexichron.operators import corpus, metadata, vectors, vocabulary
from lexichron.operators import matrix as M

CORPUS = [("p", "apostle Paul be", 2), ("p", "scholar write be", 1), ("p", "scholar be article", 1)]


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.createDataFrame(CORPUS, "period string, line string, w bigint")
    return M.line_terms(df, None, F.split("line", " "))


def test_tfidf_golden(spark, lines):
    got = {(r.line, r.term): r.value for r in M.tfidf(lines).collect()}
    assert got["apostle Paul be", "Paul"] == pytest.approx(0.6404, abs=1e-4)
    assert got["scholar be article", "article"] == pytest.approx(0.7266, abs=1e-4)
    raw = {(r.line, r.term): r.value for r in M.tfidf(lines, normalise=False).collect()}
    assert raw["apostle Paul be", "Paul"] == pytest.approx(1.5108, abs=1e-4)


def test_weights_equal_repetition(spark, lines):
    repeated = spark.createDataFrame([(p, x, 1) for p, x, w in CORPUS for _ in range(w)], "period string, line string, w bigint")
    a = {(r.row, r.col): r.value for r in M.cooccurrence(M.tfidf(lines)).collect()}
    b = {(r.row, r.col): r.value for r in M.cooccurrence(M.tfidf(M.line_terms(repeated, None, F.split("line", " ")))).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert a["Paul", "be"] == pytest.approx(0.5430, abs=1e-4) and a["be", "be"] == pytest.approx(0.6469, abs=1e-4)
    assert all(a[k] == pytest.approx(a[k[::-1]]) for k in a)


def test_counts_pmi_and_ranks(spark, lines):
    rows = lines.select("period", "line", "w", F.explode("terms").alias("t")).select("period", "line", "w", "t.term", F.col("t.tf").alias("value"))
    matrix = M.cooccurrence(rows)
    counts = {(r.row, r.col): r.value for r in matrix.collect()}
    assert counts["Paul", "apostle"] == 2 and counts["be", "be"] == 4 and ("Paul", "write") not in counts
    pmi = {(r.row, r.col): r.pmi for r in M.pmi_k(matrix).collect()}
    assert pmi["Paul", "be"] == pytest.approx(-math.log(2)) and pmi["article", "be"] == pytest.approx(-math.log(4)) and max(pmi.values()) <= 1e-12
    scaled = {(r.row, r.col): r.value for r in M.pmi_normalised(M.pmi_k(matrix)).collect()}
    assert scaled["Paul", "be"] == pytest.approx(0.75) and scaled["article", "be"] == pytest.approx(0.5) and scaled["be", "be"] == 1
    vocabulary_ = spark.createDataFrame([(t,) for t in "Paul apostle article be scholar write".split()], "term string")
    ranks = M.association_ranks(M.cooccurrence(M.tfidf(lines)), vocabulary_, ["Paul"])
    assert {r.row: r.rank for r in ranks.collect()} == {"Paul": 0, "apostle": 1, "be": 2, "article": 3, "scholar": 4, "write": 5}
    top = {(r.row, r.col): r.value for r in M.column_maximum(M.cooccurrence(M.tfidf(lines))).collect()}
    assert top["be", "Paul"] == pytest.approx(0.6619, abs=1e-4)


def test_latest_bag_and_articles(spark):
    rows = [(1, "a", "x", 5, 1), (1, "a", "y", 7, 2), (1, "b", None, 0, 1), (2, "a", "x", None, 1), (None, "a", "x", 3, 1), (2, None, "x", 3, 1), (2, "c", "z", 4, None)]
    df = spark.createDataFrame([(i, g, lem, c, None if t is None else f"2024-01-0{t}", "clash") for i, g, lem, c, t in rows], "id_kase bigint, ngram string, lemmata string, count bigint, loaded_at string, n string")
    assert sorted(tuple(r) for r in corpus.bag(df).collect()) == [(1, "a", "y", 7), (2, "c", "z", 4)]
    assert corpus.bag(df.limit(0)).count() == 0


def test_bags(spark):
    df = spark.createDataFrame([("Paul", 5), ("paul", 5), ("PAUL", 1), ("law x law", 2), ("law", 1)], "ngram string, n bigint")
    assert {r.ngram: r.n for r in B.case_variants_merged(df).collect()} == {"paul": 11, "law x law": 2, "law": 1}
    assert {r.ngram: r.n for r in B.spread_to_words(df.filter("ngram like 'law%'")).collect()} == {"law": 3, "x": 2}
    assert [r.ngram for r in B.top(df, 2).collect()] == ["Paul", "paul"]
    assert [r.ngram for r in B.top(df, 2, skip=2).collect()] == ["law x law", "PAUL"]
    kept = {r.threshold: (r.types_kept, r.tokens_kept) for r in B.coverage(df, [1, 5, 99]).collect()}
    assert kept == {1: (5, 14), 5: (2, 10), 99: (0, 0)}
    ids = spark.range(100).withColumnRenamed("id", "id_kase")
    a, b = ({r.id_kase for r in B.sample_ids(x, 10, 1).collect()} for x in (ids, ids.repartition(7)))
    assert a == b and len(a) == 10


def test_dictionary_and_bow(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "b", 1), (2, "rare", 1)], "doc_id bigint, token string, n bigint")
    words = vocabulary.dictionary(rows, 1)
    assert {r.token: (r.token_id, r.df) for r in words.collect()} == {"a": (0, 1), "b": (1, 2), "rare": (2, 1)}
    known = words.filter("token <> 'rare'")
    assert {r.doc_id: [tuple(x) for x in r.bow] for r in vocabulary.bag_of_words(rows, known).collect()} == {1: [(0, 1), (1, 2)], 2: [(1, 1)]}


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0]), ("z", [0.0, 0.0]), ("n", None)], "word string, vec array<double>")
    asked = spark.createDataFrame([("a",), ("missing",)], "word string")
    got = [(r.query, r.word, r.rank) for r in vectors.neighbours(asked, df, 2).orderBy("rank").collect()]
    assert got == [("a", "b", 1), ("a", "c", 2)]
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    similar = {r.b: r.similarity for r in vectors.pair_similarity(pairs, df).collect()}
    assert similar["b"] == pytest.approx(1 / math.sqrt(2)) and similar["z"] is None
    assert vectors.circle(["x", "y"], "x") == [("x", 0.0, 0.0), ("y", 1.0, 0.0)]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (20,), (21,), (None,)], "y int")
    assert {r.bin_start: r.n for r in metadata.histogram(df, "y", [0, 10, 20]).collect()} == {0: 2, 10: 2}
