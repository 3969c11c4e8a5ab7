"""Readers, writers, the search source and the stream, over small files."""

import gzip
import json

from pyspark.sql import functions as F

from lexichron.sources import readers, search, writers
from lexichron.streaming import bags


def test_json_lines_and_counts(spark, tmp_path):
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "a", "language": ["eng"], "trigramCount": {"x y z": 2}}) + "\n" + json.dumps({"id": "b"}) + "\n")
    df = readers.json_lines(spark, str(tmp_path / "c.jsonl.gz"), partitions=2)
    assert [tuple(r) for r in readers.counts_of(df).collect()] == [("a", "x y z", 2)]


def test_column_json_and_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"title": {"0": "t", "1": "u"}, "year": {"0": 1950, "1": None}}))
    assert sorted((r.title, r.year) for r in readers.column_json(spark, str(tmp_path / "m.json"), "title string, year int").collect()) == [("t", 1950), ("u", None)]
    (tmp_path / "trigrams_17.json").write_text('{"a b c": 3}')
    assert [tuple(r) for r in readers.ngram_maps(spark, str(tmp_path / "trigrams_17.json")).collect()] == [(17, "a b c", 3)]


def test_lines_settings_and_writers(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a \n\nb\n")
    assert [r.line for r in readers.lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]
    (tmp_path / "d.json").write_text('["1900,1909"]')
    assert [tuple(r) for r in readers.periods(spark, str(tmp_path / "d.json")).collect()] == [("1900-1909", 1900, 1909)]
    rows = spark.createDataFrame([("p", "x y", 2), ("p", "z", 0)], "period string, line string, w bigint")
    assert [r.line for r in writers.repeated_lines(rows).collect()] == ["x y", "x y"]
    assert writers.lines_by_period(rows, str(tmp_path / "out")).first().lines == 2


def test_search_source(spark):
    def fetch(query, start, count):
        import json

        entries = [{"n": k} for k in range(5)][start : start + count]
        return json.dumps({"search-results": {"opensearch:totalResults": "5", "entry": entries}})

    spark.dataSource.register(search.search_source(fetch))
    df = spark.read.format("paged_search").option("query", search.any_of(["faith"])).option("page", "2").load()
    assert sorted(r.entry_id for r in df.collect()) == [0, 1, 2, 3, 4]
    assert search.page_starts(5, 2) == [0, 2, 4]
    assert search.hit_counts(spark, ["a"], ["T"], fetch).first().hits == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "ngram string, n bigint")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = bags.merged(bags.arriving(spark, str(tmp_path / "in"), rows.schema), ["ngram"])
    query = bags.into_table(stream, "bag_stream", str(tmp_path / "check"))
    query.awaitTermination(60)
    want = {r.ngram: r.n for r in rows.groupBy("ngram").agg(F.sum("n").alias("n")).collect()}
    assert {r.ngram: r.n for r in spark.table("bag_stream").collect()} == want
