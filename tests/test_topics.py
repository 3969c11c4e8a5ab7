"""Topics: training uses every document and every word, and coherence is as worked out by hand."""

import math

import pytest

from lexichron.operators import topics


def test_training_sees_every_document_and_word(spark):
    n = 2500  # more words than the vocabulary once had; each is of one document only
    docs = spark.createDataFrame([(i, [f"w{i}"] * 50) for i in range(n)], "doc_id int, tokens array<string>")
    counter, model = topics.fit(docs, topics=2, least=1)
    assert len(counter.vocabulary) == n
    totals = model.topicsMatrix().toArray().sum(axis=1)
    assert totals.min() > 5  # a word whose document never came up keeps less than its first 2
    words = topics.term_topics(counter, model)
    assert words.count() == 2 * n and words.filter("topic = 0").agg({"weight": "sum"}).first()[0] == pytest.approx(1)


def test_coherence(spark):
    docs = spark.createDataFrame([("x", ["a", "b", "b"]), ("x", ["a"]), ("x", ["c"]), ("y", ["b"]), (None, ["a"])], "source string, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a")], "topic int, rank int, term string")
    got = {(r.source, r.topic): (r.coherence, r.rank) for r in topics.coherence(docs, words, "source").collect()}
    assert got["x", 0] == (pytest.approx(math.log(1 / 2)), 2) and got["x", 1] == (pytest.approx(0, abs=1e-9), 1)
    assert got["y", 1][0] == pytest.approx(math.log(1e-12)) and ("y", 0) not in got
