"""Sinks and loaders of dictionaries, bags of words, word vectors and topic models: Parquet tables and the ML library's own form."""

from __future__ import annotations

from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession


def _saved(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").parquet(path)


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    _saved(dictionary, path, ["token", "token_id", "df"])


def save_bags_of_words(bags: DataFrame, path: str, doc: str = "doc_id") -> None:
    """All bags as one table instead of a file for each document."""
    _saved(bags.withColumnRenamed(doc, "doc_id"), path, ["doc_id", "bow"])


def save_vectors(vectors: DataFrame, path: str, by: str | None = None) -> None:
    """Word vectors, in a folder for each value of ``by`` if there is one."""
    writer = vectors.select(*([by] if by else []), "word", "vec").write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary, bags of words or vectors."""
    return spark.read.parquet(path)


def save_topics(counter: CountVectorizerModel, model: LocalLDAModel, path: str) -> None:
    counter.write().overwrite().save(f"{path}/vectoriser")
    model.write().overwrite().save(f"{path}/topics")


def load_topics(path: str) -> tuple[CountVectorizerModel, LocalLDAModel]:
    return CountVectorizerModel.load(f"{path}/vectoriser"), LocalLDAModel.load(f"{path}/topics")
