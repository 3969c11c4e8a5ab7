"""Sinks and loaders, samples, small things about frames, lemmas, and pruned plans."""

import random
import io
import pickle
from collections import Counter

import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexichron import session
from lexichron.functions import text as T
from lexichron.operators import bags as B
from lexichron.operators import frames, lemmas, numbering, vectors, vocabulary
from lexichron.operators import matrix as M
from lexichron.sources import models, readers, writers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression("x")).first()[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked_for(spark, sf_dir):
    scan = next(x for x in plan(entry.queries()["decade_counts"](spark, sf_dir)).splitlines() if "ReadSchema" in x)
    assert scan.split("ReadSchema: ")[1].count(":") == 3, scan
    merged = plan(entry.queries()["ngram_threshold_counts"](spark, sf_dir))
    assert "lemmata" not in merged.split("ReadSchema: ")[1]
    assert "EqualTo(ngram,covenant)" in plan(entry.queries()["point_lookup"](spark, sf_dir))


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(i * 37 % 1000, None if i % 9 else "x") for i in range(1000)], "k bigint, v string").repartition(7)
    got = numbering.numbered(df, ["k"]).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert numbering.numbered(df.limit(0), ["k"]).count() == 0


def test_draws_have_the_size_asked_for(spark):
    lines = spark.createDataFrame([("a", 1), ("b", 9), (" ", 50), ("c", 0), ("d", 90)], "line string, w bigint")
    n = Counter(r.line for r in B.sample_lines(lines, 1000, 3).collect())
    assert sum(n.values()) == 1000 and set(n) <= {"a", "b", "d"} and 850 < n["d"] < 950
    assert n == Counter(r.line for r in B.sample_lines(lines.repartition(5), 1000, 3).collect())
    assert B.sample_lines(lines.limit(0), 5, 1).count() == 0 and B.sample_lines(lines.select("line"), 7, 1).count() == 7
    rows = spark.range(20)
    assert frames.draw_rows(rows, 50, 1, ["id"]).count() == 50 and frames.draw_rows(rows.limit(0), 5, 1, ["id"]).count() == 0
    a, b = (sorted(r.id for r in frames.random_rows(x, 5, 2).collect()) for x in (rows, rows.repartition(6)))
    assert a == b and len(set(a)) == 5


def test_frames(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "a", 3), ("g", None, 2), ("g", "b", None)], "g string, k string, v int")
    assert df.groupBy("g").agg(frames.as_map("k", "v").alias("m")).first().m == {"a": 3, "b": None}
    assert frames.shape(df) == (4, 3) and frames.columns_like(df, "[gk]") == ["g", "k"]
    known = spark.createDataFrame([("a", 7)], "k string, x int")
    assert frames.strict_join(df.filter("k = 'a'"), known, "k").count() == 2
    with pytest.raises(KeyError, match="b"):
        frames.strict_join(df.filter("k = 'b'"), known, "k")


def test_matrix_forms(spark):
    matrix = spark.createDataFrame([("p", "a", "b", 0.5), ("p", "c", "a", 2.0)], "period string, row string, col string, value double")
    assert {tuple(r) for r in M.transposed(matrix).collect()} == {("p", "b", "a", 0.5), ("p", "a", "c", 2.0)}
    got = {(r.row, r.col): r.value for r in M.filled(matrix, ["a", "b"]).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 0.5, ("b", "a"): 0, ("b", "b"): 0}
    rows = spark.createDataFrame([(1, "a", 2), (2, "z", 1)], "doc int, term string, n int")
    assert sorted(tuple(r) for r in M.dense(rows, "doc", ["a", "b"]).collect()) == [(1, 2, 0), (2, 0, 0)]
    edges = spark.createDataFrame([("b", "a", 1.0), ("a", "b", 2.0), ("a", "c", 3.0)], "src string, dst string, weight double")
    assert {tuple(r) for r in vectors.undirected(edges).collect()} == {("a", "b", 2.0), ("a", "c", 3.0)}
    assert vectors.subgraph(edges, ["a", "b"]).count() == 2


def test_text_functions(spark):
    assert one(spark, "Straße\u00a0x١ ٢", T.strip_digits) == "Straße\u00a0x "
    assert one(spark, "a\u2009b\u3000c", T.word_count) == 3
    assert one(spark, "the b, a2 'c", lambda x: T.sorted_words(x, ["the"])) == "'c a b"
    assert one(spark, "New York", T.replaced_whole) == "New_York" and one(spark, "New York x", T.replaced_whole) == "New York x"
    assert one(spark, "Running jumps", T.text_stems) == "run jump" and T.stem_text(None) is None
    assert one(spark, "20000000", T.million) == "20M" and one(spark, "1.5", T.decimals) == "1.500000"


def test_lemmas(spark):
    asked = []

    def lemmatise(texts):
        asked.extend(texts)
        return [[(w.rstrip("s"), "NOUN" if w != "of" else "ADP") for w in t.split()] + [(None, "NOUN")] for t in texts]

    merged = spark.createDataFrame([("laws of cities", 9), ("of", 9), ("rare", 2), (None, 9)], "ngram string, n bigint")
    got = {r.ngram: (r.lemmata, r.n) for r in lemmas.lemma_dictionary(merged, lambda t: [[(w.rstrip("s"), "ADP" if w == "of" else "NOUN") for w in x.split()] for x in t], 5).collect()}
    assert got == {"laws of cities": ("law citie", 9)}
    rows = spark.createDataFrame([(1, "b a", 2), (1, "a b", 3), (2, "new", 1), (2, "--", 4)], "id_kase int, ngram string, n bigint")
    known = spark.createDataFrame([("b a", "b a"), ("a b", "a b"), ("--", "--")], "ngram string, lemmata string")
    assert {tuple(r) for r in lemmas.documents_to_lemmata(rows, known).collect()} == {(1, "a b", 5)}
    more = lemmas.documents_to_lemmata(rows, known, lambda t: [[(x.upper(), "NOUN")] for x in t])
    assert {tuple(r) for r in more.collect()} == {(1, "a b", 5), (2, "New", 1)}
    assert lemmas.lemma_dictionary(merged.limit(0), lemmatise).count() == 0


def test_cleaned_vocabulary(spark):
    rows = [("Ot", 3), ("law1", 2), ("the", 9), ("Press", 1), ("ab", 4), ("Ps", 4), ("Law", 5), ("λόγος", 1)]
    got = {r.ngram: r.n for r in lemmas.cleaned_vocabulary(spark.createDataFrame(rows, "ngram string, n bigint"), ["", "press", "the"]).collect()}
    assert got == {"Old_Testament": 3, "Law": 7, "Ps": 4}


def test_sinks_and_loaders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "doc_id bigint, token string, n bigint")
    words = vocabulary.dictionary(rows)
    models.save_dictionary(words, f"{tmp_path}/d")
    assert {tuple(r) for r in models.load(spark, f"{tmp_path}/d").collect()} == {("a", 0, 1), ("b", 1, 1)}
    models.save_bags_of_words(vocabulary.bag_of_words(rows, words), f"{tmp_path}/b")
    assert [tuple(x) for x in models.load(spark, f"{tmp_path}/b").first().bow] == [(0, 1), (1, 2)]
    assert [tuple(r) for r in vocabulary.tokens_of(words, spark.createDataFrame([(1,), (9,)], "token_id bigint")).collect()] == [(1, "b")]
    models.save_vectors(spark.createDataFrame([("p", "w", [1.0])], "period string, word string, vec array<double>"), f"{tmp_path}/v", by="period")
    assert models.load(spark, f"{tmp_path}/v").first().period == "p"
    table = spark.range(100)
    assert writers.in_parts(table, f"{tmp_path}/parts", "id", 4) == [0, 1, 2, 3]
    (tmp_path / "parts" / "part=2" / "_SUCCESS").unlink()
    assert writers.in_parts(table, f"{tmp_path}/parts", "id", 4) == [2] and spark.read.parquet(f"{tmp_path}/parts").count() == 100
    writers.csv(table, f"{tmp_path}/c")
    with pytest.raises(ValueError, match="99"):
        writers.csv(table, f"{tmp_path}/c", most=99)
    writers.figure(spark.createDataFrame([(1900, 1.0, "a"), (1920, 2.0, "a"), (1900, 3.0, "b & c")], "x int, y double, s string"), f"{tmp_path}/f.svg", "x", "y", "s")
    assert (tmp_path / "f.svg").read_text().count("<polyline") == 2


def test_pickles_and_feather(spark, tmp_path):
    (tmp_path / "a.pickle").write_bytes(pickle.dumps(Counter({"x": 2})))
    assert [(r.key, r.n) for r in readers.pickled_counts(spark, f"{tmp_path}/a.pickle").collect()] == [("x", 2)]
    with pytest.raises(pickle.UnpicklingError, match="no plain value"):
        readers._PlainUnpickler(io.BytesIO(pickle.dumps(print))).load()
    for k in range(2):
        pyarrow.feather.write_feather(pa.table({"k": [k, k + 10], "t": ["a", None]}), f"{tmp_path}/{k}.feather")
    assert sorted(r.k for r in readers.columnar(spark, f"{tmp_path}/*.feather").collect()) == [0, 1, 10, 11]
    (tmp_path / "s.txt").write_text("the\n\n# note\n of \nthe\n")
    assert {r.word for r in readers.word_list(spark, f"{tmp_path}/s.txt").collect()} == {"the", "of"}
    (tmp_path / "r.json").write_text('{"a": "b"}')
    assert [tuple(r) for r in readers.replacements(spark, f"{tmp_path}/r.json").collect()] == [("a", "b")]
    assert readers.local_or_remote(f"{tmp_path}/r.json", "x") == f"{tmp_path}/r.json" and readers.local_or_remote("/no/such", "x") == "x"


def test_written_tables_are_discarded(spark):
    df = session.written(spark.range(3), "t")
    assert df.count() == 3
    session.discard(df)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(*df.inputFiles()).count()
    told = []
    with session.timed("x", told.append):
        pass
    assert told[0].startswith("x: ")


# Words and their stems from the published vocabulary of the English Snowball stemmer.
STEMS = {
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consisting": "consist", "consolations": "consol", "consolingly": "consol", "conspicuously": "conspicu",
    "knightly": "knight", "knitting": "knit", "knives": "knive", "knocked": "knock", "knots": "knot", "running": "run", "happiness": "happi", "relational": "relat", "studies": "studi",
    "generously": "generous", "generate": "generat", "communism": "communism", "skies": "sky", "dying": "die", "proceed": "proceed", "ties": "tie", "gas": "gas", "this": "this",
    "hopping": "hop", "hoping": "hope", "falling": "fall", "agreed": "agre", "by": "by", "say": "say", "cry": "cri", "controll": "control", "rational": "ration", "youth's": "youth",
}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_snowball(word, stem):
    from lexichron.functions.snowball import snowball

    assert snowball(word) == stem


def test_map_keeps_neighbours_together(spark):
    rows = [(k, [1.0 + k % 7 / 100, k % 5 / 100, 0.0]) for k in range(20)] + [(100 + k, [0.0, k % 5 / 100, 1.0 + k % 7 / 100]) for k in range(20)] + [(500, None)]
    df = spark.createDataFrame(rows, "word int, vec array<double>")
    got = {r.word: (r.x1, r.x2) for r in vectors.mapped(df, perplexity=5).collect()}
    assert len(got) == 40 and all(0 <= x <= 1 for p in got.values() for x in p)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(got[a], got[b]))
    nearest = {w: min((o for o in got if o != w), key=lambda o: far(w, o)) for w in got}
    assert all((w < 100) == (o < 100) for w, o in nearest.items())
    with pytest.raises(ValueError, match="choose words"):
        vectors.mapped(df, most=3)


def test_trigram_bows_within_documents(spark):
    # Odd cases against the same steps by shuffles: digits, pairs, replacements of two words, separators, repeated and null ids.
    from lexichron.operators import trigrams

    rng = random.Random(7)
    pool = "New Testament Nt ot Rom 12 w12 124w 1 2x Christian Jewish jewish christian Paul s Old York a b law law grace\x1cof x　y σΣ ١٢ st Saint Denis".split(" ")
    rows = [(k % 37 if k % 11 else None, " ".join(rng.choice(pool) for _ in range(k % 23))) for k in range(120)] + [(900, None), (901, " two  words "), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.bow): r.w for r in trigrams.bows(docs, 5).collect()}
    assert found == {(r.doc_id, r.bow): r.w for r in trigrams.bows(docs, 5, most_tokens=0).collect()}
    assert any(k is None for k, _ in found) and len(found) == trigrams.bows(docs, 5).count() > 100
    plan = trigrams.bows(docs.filter("doc_id >= 0").dropDuplicates(["doc_id"]).localCheckpoint(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no trigram is shuffled
