"""Incremental bag merge: counts per period and n-gram, kept up as files of rows arrive.

The sum is commutative, so late rows need no watermark; with one, state older
than it is dropped and results are appended once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def merged(stream: DataFrame, by: list[str]) -> DataFrame:
    """Counts ``n`` summed per ``by``; write it in ``update`` or ``complete`` mode."""
    return stream.groupBy(*by).agg(F.sum("n").alias("n"))


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per window of time, each emitted once rows later than ``late`` no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def into_table(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs through what is there, into a table in memory."""
    return result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
