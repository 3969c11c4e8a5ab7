"""Word vectors of each period, over lines with their repetitions."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.operators import vectors
from lexichron.plans import matrices

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, "1905-01-01" if i < 6 else "1925-01-01", i) for i in range(12)]
    spark.createDataFrame(rows, "id_kase bigint, datePublished string, ingested_at bigint").write.parquet(f"{d}/metadata_df.parquet")
    texts = [(i, i, "Covenant of law." if i < 6 else "Covenant of grace.") for i in range(12)]
    spark.createDataFrame(texts, "doc_id bigint, id_kase bigint, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_neighbours_per_period(spark, folder):
    # Each line is there six times: without repetitions no word reaches five.
    rows = matrices.QUERIES["word2vec_neighbours"](spark, folder).collect()
    found = {(r.period, r.query): {x.word for x in rows if (x.period, x.query) == (r.period, r.query)} for r in rows}
    assert found == {("1900-1919", "covenant"): {"of", "law"}, ("1920-1939", "covenant"): {"of", "grace"}}


def test_train_per_defaults(spark):
    lines = spark.createDataFrame([("a", "x y")] * 5 + [("b", "x")], "period string, line string")
    rows = vectors.train_per(lines, "period").collect()
    assert {(r.period, r.word, len(r.vec)) for r in rows} == {("a", "x", 100), ("a", "y", 100)}
    assert vectors.train_per(lines.limit(0), "period").count() == 0
    drawn = vectors.train_per(lines.withColumn("w", F.lit(50)), "period", most_lines=60).collect()
    assert {(r.period, r.word) for r in drawn} == {("a", "x"), ("a", "y"), ("b", "x")}


def test_cbow_finds_words_of_like_contexts():
    rng = random.Random(4)
    lines = [f"{rng.choice(['cat', 'dog'])} {rng.choice(['eats', 'drinks'])} {rng.choice(['milk', 'meat'])}".split() for _ in range(400)]
    lines += [f"{rng.choice(['king', 'queen'])} {rng.choice(['rules', 'governs'])} {rng.choice(['land', 'sea'])}".split() for _ in range(400)]
    words, found = vectors.cbow(lines, size=16, epochs=40, exponent=0.75)
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    like = lambda a, b: float(unit[words.index(a)] @ unit[words.index(b)])
    assert like("cat", "dog") > like("cat", "queen") and like("rules", "governs") > like("rules", "drinks")
    assert np.array_equal(found, vectors.cbow(lines, size=16, epochs=40, exponent=0.75)[1])


def test_large_groups_are_trained_whole(spark):
    # Sixty words of five lines each: a draw of lines would miss some of them or some of their repetitions.
    lines = spark.createDataFrame([("a", f"w{k} x y", 5) for k in range(60)] + [("b", "x y", 9)], "period string, line string, w bigint")
    rows = vectors.train_per(lines, "period", most_lines=50, size=8, epochs=2).collect()
    assert {(r.period, r.word, len(r.vec)) for r in rows} == {("a", w, 8) for w in ["x", "y", *[f"w{k}" for k in range(60)]]} | {("b", "x", 8), ("b", "y", 8)}
    again = vectors.train_per(lines.repartition(3), "period", most_lines=50, size=8, epochs=2).collect()
    assert {(r.period, r.word): r.vec for r in rows} == {(r.period, r.word): r.vec for r in again}


def test_shards_find_words_of_like_contexts(spark):
    rng = random.Random(4)
    lines = [f"{rng.choice(['cat', 'dog'])} {rng.choice(['eats', 'drinks'])} {rng.choice(['milk', 'meat'])}" for _ in range(400)]
    lines += [f"{rng.choice(['king', 'queen'])} {rng.choice(['rules', 'governs'])} {rng.choice(['land', 'sea'])}" for _ in range(400)]
    each = spark.createDataFrame([("a", x, 10) for x in lines], "period string, line string, w bigint")
    found = vectors.train_per(each, "period", most_lines=4000, size=16, epochs=8, exponent=0.75)
    near = {r.query: r.word for r in vectors.neighbours(found.filter("word in ('cat', 'rules')").select("word"), found.select("word", "vec"), 1).collect()}
    assert near == {"cat": "dog", "rules": "governs"}


def test_repetitions_are_trained_on():
    # Of the lines 0 1, 2 and -1 0 3, three, one and two times there, two have words to learn from.
    held = vectors._Lines(np.array([0, 1, 2, -1, 0, 3]), np.array([2, 1, 3]), np.array([3, 1, 2]))
    assert (held.tokens.tolist(), held.each.tolist(), held.positions) == ([0, 1, 0, 3], [0, 0, 0, 1, 1], 10)


SPEED = """
import time
import numpy as np
from lexichron.operators import vectors
rng = np.random.default_rng(1)
lines = [[f"w{k}" for k in line] for line in (rng.zipf(1.3, (4000, 10)) % 2000)]
rows = rng.random((1280, 100)).astype(np.float32)
places = np.sort(rng.zipf(1.3, 1280) % 2000)
begins = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
began = time.process_time()
for _ in range(400):
    np.add.reduceat(rows, begins, axis=0)
unit, began = time.process_time() - began, time.process_time()
vectors.cbow(lines, epochs=2)
print((time.process_time() - began) / unit)
"""


def test_training_speed():
    # Against sums of rows one by one on the same machine: 1.3 to 1.6 times their time; 4.4 to 4.7 when the steps of a batch were added up so.
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    said = [float(subprocess.run([sys.executable, "-c", SPEED], env=env, capture_output=True, text=True, check=True).stdout) for _ in range(3)]
    assert min(said) < 3
