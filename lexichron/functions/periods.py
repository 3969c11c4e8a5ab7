"""Years and periods as column expressions, and the table of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def year_of(date: Column | str) -> Column:
    """The year before the first hyphen of a date written as text; null if it is no number."""
    return F.split_part(_col(date), F.lit("-"), F.lit(1)).try_cast("int")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decade_of(year: Column | str) -> Column:
    """First year of the decade."""
    return (F.floor(_col(year) / 10) * 10).cast("bigint")


def period_of(year: Column | str, width: int, first: int, last: int) -> Column:
    """Label ``start-end`` of the period of ``width`` years; null outside ``first``..``last``."""
    year = _col(year)
    start = (F.lit(first) + F.floor((year - first) / width) * width).cast("int")
    label = F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string"))
    return F.when(year.between(first, last), label)


def bidecade_of(year: Column | str) -> Column:
    return period_of(year, 20, 1900, 2019)


def halfdecade_of(year: Column | str) -> Column:
    return period_of(year, 5, 1990, 2019)


def period_table(spark: SparkSession, width: int, first: int, last: int) -> DataFrame:
    """``label, start_year, end_year, midpoint`` of all periods of a width."""
    starts = spark.range(first, last + 1, width).select(F.col("id").cast("int").alias("start_year"))
    ends = starts.withColumn("end_year", (F.col("start_year") + width - 1).cast("int"))
    return ends.select(
        F.concat_ws("-", "start_year", "end_year").alias("label"),
        "start_year",
        "end_year",
        midpoint_of(F.concat_ws("-", "start_year", "end_year"), width).alias("midpoint"),
    )


def midpoint_of(label: Column | str, width: int) -> Column:
    """The year in the middle of a labelled period."""
    return F.substring(_col(label), 1, 4).cast("int") + width // 2
