"""Statistics over articles. Null groups are left out; sums of nothing are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(articles: DataFrame, key: str) -> DataFrame:
    return articles.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def sums(articles: DataFrame, key: str, columns: list[str]) -> DataFrame:
    total = [F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(f"sum_{c}") for c in columns]
    return articles.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *total)


def means(articles: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return articles.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def range_stats(articles: DataFrame, key: str, column: str) -> DataFrame:
    """Count, mean, least and greatest of a column per group, in one aggregation."""
    return (
        articles.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    )


def totals(articles: DataFrame, column: str) -> DataFrame:
    return articles.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0)).alias("total"),
        F.avg(column).alias("mean"),
        F.min(column).alias("least"),
        F.max(column).alias("greatest"),
    )


def histogram(articles: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """``bin_start, n``: counts in bins between edges, each closed below, the last also above; values outside are left out."""
    value = F.col(column)
    start = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        inside = (value >= edges[k]) & ((value < edges[k + 1]) | ((value == edges[k + 1]) & F.lit(k == len(edges) - 2)))
        start = F.when(inside, F.lit(edges[k])).otherwise(start)
    return articles.select(start.alias("bin_start")).filter("bin_start is not null").groupBy("bin_start").agg(F.count("*").alias("n"))
