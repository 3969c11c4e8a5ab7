"""Readers: compressed JSON lines, column-wise JSON, n-gram maps, text lines, settings."""

from __future__ import annotations

import io
import json
import os
import pickle
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

COUNTS = T.MapType(T.StringType(), T.LongType())
METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "subTitle", "datePublished", "docType", "docSubType", "doi", "isPartOf")]
    + [T.StructField(n, T.StringType()) for n in ("volumeNumber", "issueNumber", "pageStart", "pageEnd", "pagination", "provider", "publisher")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("creator", "keyphrase", "language")]
    + [T.StructField(n, T.LongType()) for n in ("pageCount", "wordCount", "publicationYear")]
)
RECORD = T.StructType([*METADATA.fields, *[T.StructField(n, COUNTS) for n in ("unigramCount", "bigramCount", "trigramCount")], T.StructField("abstract", T.StringType())])


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, partitions: int | None = None) -> DataFrame:
    """Records of JSON lines, compressed or not. A gzip file can't be split: ``partitions`` deals its rows out after reading."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def counts_of(records: DataFrame, column: str = "trigramCount", id_column: str = "id") -> DataFrame:
    """``id, ngram, n``: a record's map of counts as rows; none of a null map."""
    return records.select(id_column, F.explode(column).alias("ngram", "n"))


def column_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table stored as ``{column: {index: value}}``, one JSON text a file. ``schema`` names columns and types."""
    fields = T._parse_datatype_string(schema).fields
    kind = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType)) for f in fields])
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("t"))
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(f"t.{f.name}"), F.array().cast("array<string>")) for f in fields])))
    rows = parsed.select("t", F.explode(keys).alias("key"))
    return rows.select(*[F.try_element_at(F.col(f"t.{f.name}"), F.col("key")).alias(f.name) for f in fields])


def ngram_maps(spark: SparkSession, path: str) -> DataFrame:
    """``doc, ngram, n`` of files that each hold one document's map of counts; ``doc`` is the number in the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", COUNTS).alias("m"), F.regexp_extract(F.input_file_name(), r"(\d+)\.\w+$", 1).alias("d"))
    return files.select(F.col("d").try_cast("bigint").alias("doc"), F.explode("m").alias("ngram", "n"))


class _PlainUnpickler(pickle.Unpickler):
    """Reads numbers, texts and containers only: nothing that a file names is imported or run, but for counters."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "Counter"):
            return Counter
        raise pickle.UnpicklingError(f"no plain value: {module}.{name}")


def pickled_counts(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, n`` of pickled maps of counts, a row for each entry; files that hold anything else raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = _PlainUnpickler(io.BytesIO(content)).load()
                columns = [pa.array([name] * len(counts), pa.string()), pa.array([str(k) for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "key", "n"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, key string, n bigint")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of text files, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def columnar(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or Feather files of one schema, each read in a task of its own, batch by batch."""
    if not path.endswith((".feather", ".arrow")):
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").orderBy("path").first()
    if first is None:
        raise FileNotFoundError(path)
    head = files.filter(F.col("path") == first[0]).select("content").first()[0]
    schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(head)).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k)

    return files.select("content").mapInArrow(run, schema)


def word_list(spark: SparkSession, *paths: str, column: str = "word") -> DataFrame:
    """The union of word lists kept as text files, one word a line; blank lines and lines that begin with # are left out."""
    words = spark.read.text(list(paths)).select(F.trim("value").alias(column))
    return words.filter((F.col(column) != "") & ~F.col(column).startswith("#")).distinct()


def replacements(spark: SparkSession, path: str) -> DataFrame:
    """``before, after`` of a JSON map kept with the settings."""
    return spark.createDataFrame(list(json.loads(Path(path).read_text()).items()), "before string, after string")


def periods(spark: SparkSession, path: str) -> DataFrame:
    """``label, start_year, end_year`` of a JSON list of texts ``start,end``."""
    rows = [(f"{a}-{b}", int(a), int(b)) for a, b in (x.split(",") for x in json.loads(Path(path).read_text()))]
    return spark.createDataFrame(rows, "label string, start_year int, end_year int")


def local_or_remote(path: str, remote: str) -> str:
    """The local path if it exists, else the remote one."""
    return path if os.path.exists(path) else remote
