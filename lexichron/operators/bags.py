"""Bags of n-grams: merging, ranking, relative frequencies, remapping.

A bag is a long table with a count column ``n``.  Sums are partial before the
shuffle, so frequent n-grams don't skew it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexichron.operators.numbering import numbered
from lexichron.session import written

#: Rows of one block of a running sum.
BLOCK_ROWS = 100_000


def merge(rows: DataFrame, key: str = "ngram", by: list[str] | None = None) -> DataFrame:
    """Counts summed over documents, within ``by``."""
    return rows.groupBy(*(by or []), key).agg(F.sum("n").alias("n"))


def of_documents(rows: DataFrame, ids: DataFrame, id_column: str = "id_kase") -> DataFrame:
    """The rows of the listed documents. A document listed twice counts twice."""
    return rows.join(ids.select(id_column), id_column)


def top(merged: DataFrame, k: int, key: str = "ngram", skip: int = 0) -> DataFrame:
    """The ``k`` most frequent keys after the first ``skip``; ties in order of the key."""
    ordered = merged.orderBy(F.desc("n"), key)
    return (ordered.offset(skip) if skip else ordered).limit(k)


def top_per(merged: DataFrame, group: str, k: int, key: str = "ngram") -> DataFrame:
    """The ``k`` most frequent keys of each group, with their rank from 1. Spark limits each group before the shuffle."""
    order = W.partitionBy(group).orderBy(F.desc("n"), key)
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def without(merged: DataFrame, keys: DataFrame, key: str = "ngram") -> DataFrame:
    """Keys of ``keys`` deleted."""
    return merged.join(keys.select(key), key, "left_anti")


def percentages(numerators: DataFrame, totals: DataFrame, by: str, wordlist: list[str], key: str = "ngram") -> DataFrame:
    """``by, key, pct``: each listed word's share of the group's total in per cent; 0 where it is absent.

    ``totals`` has ``by`` and ``total``.  Zero totals give null.
    """
    spark = numerators.sparkSession
    listed = spark.createDataFrame([(w,) for w in wordlist], f"{key} string")
    scaffold = totals.crossJoin(F.broadcast(listed))  # the word list is a parameter
    held = numerators.filter(F.col(key).isin(wordlist)).select(by, key, "n")
    pct = F.try_divide(F.coalesce(F.col("n"), F.lit(0)) * 100.0, F.col("total"))
    return scaffold.join(held, [by, key], "left").select(by, key, pct.alias("pct"))


def remapped(rows: DataFrame, new_key: Column, key: str = "ngram", by: list[str] | None = None) -> DataFrame:
    """Counts after renaming keys; keys that become alike add up, empty ones are dropped."""
    return merge(rows.withColumn(key, new_key).filter(F.length(key) > 0), key, by)


def last_write_wins(rows: DataFrame, new_key: Column, order: str, key: str = "ngram") -> DataFrame:
    """Counts after renaming keys, where of keys that become alike the last by ``order`` stands."""
    return rows.withColumn(key, new_key).groupBy(key).agg(F.max_by("n", order).alias("n"))


def case_variants_merged(merged: DataFrame, key: str = "ngram") -> DataFrame:
    """Case variants of a word summed under the most frequent one; of equal ones the lower-case form, then the least."""
    lowered = F.lower(key)
    order = F.struct((-F.col("n")).alias("n"), (F.col(key) != lowered).alias("l"), F.col(key).alias("k"))
    return merged.groupBy(lowered.alias("folded")).agg(F.min(order)["k"].alias(key), F.sum("n").alias("n")).select(key, "n")


def spread_to_words(merged: DataFrame, key: str = "ngram") -> DataFrame:
    """An n-gram's count given to each distinct word of it."""
    words = F.array_distinct(F.filter(F.split(key, r"\s+"), lambda w: w != ""))
    return merge(merged.select(F.explode(words).alias(key), "n"), key)


def coverage(merged: DataFrame, thresholds: list[int]) -> DataFrame:
    """``threshold, types, tokens, types_kept, tokens_kept, pct_kept``: what is left of a bag at each least count."""
    each = F.explode(F.array(*[F.lit(t).cast("bigint") for t in thresholds])).alias("threshold")
    kept = F.col("n") >= F.col("threshold")
    return (
        merged.select("n", each)
        .groupBy("threshold")
        .agg(
            F.count("*").alias("types"),
            F.sum("n").alias("tokens"),
            F.count_if(kept).alias("types_kept"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("tokens_kept"),
        )
        .withColumn("pct_kept", F.try_divide(F.col("tokens_kept") * 100.0, F.col("tokens")))
    )


def pivoted(merged: DataFrame, periods: list[str], key: str = "ngram", by: str = "period") -> DataFrame:
    """One row per key and a count column per period; 0 where it is absent."""
    wide = merged.groupBy(key).pivot(by, periods).agg(F.sum("n"))
    return wide.fillna(0, subset=periods)


def sample_ids(ids: DataFrame, k: int, seed: int, id_column: str = "id_kase") -> DataFrame:
    """``k`` ids drawn without replacement, the same for every partitioning."""
    return ids.select(id_column).distinct().orderBy(F.xxhash64(id_column, F.lit(seed)), id_column).limit(k)


def sample_lines(lines: DataFrame, k: int, seed: int) -> DataFrame:
    """``line``: exactly ``k`` lines drawn with replacement, a line of weight ``w`` as if it stood there ``w`` times; blank ones are never drawn.

    A place in the run of all repetitions is drawn; the line it falls in is found by a sort of lines and draws together.
    """
    weighted = lines if "w" in lines.columns else lines.withColumn("w", F.lit(1))
    usable = weighted.filter((F.trim("line") != "") & (F.col("w") > 0)).groupBy("line").agg(F.sum("w").cast("bigint").alias("w"))
    placed = numbered(usable, ["line"], "_row")
    # ends of the lines' runs: sums within blocks of rows, after the sums of the blocks before
    blocks = placed.withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS))
    sums = blocks.groupBy("_block").agg(F.sum("w").alias("_w"))
    before = F.coalesce(F.sum("_w").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a block
    within = F.sum("w").over(W.partitionBy("_block").orderBy("_row"))
    ends = written(blocks.join(F.broadcast(sums.select("_block", before.alias("_before"))), "_block").select("line", "w", (F.col("_before") + within).alias("end")), "line-ends")
    total = ends.agg(F.max("end")).first()[0]
    if not total:
        return lines.select("line").limit(0)
    drawn = lines.sparkSession.range(k).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("at"))
    counted = drawn.groupBy("at").agg(F.count("*").alias("times"))
    width = max(1, total // BLOCK_ROWS)  # a draw meets only lines whose run touches its stretch of places
    stretches = ends.select("line", (F.col("end") - F.col("w")).alias("begin"), "end")
    stretches = stretches.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    met = counted.withColumn("cell", F.floor(F.col("at") / width)).join(stretches, "cell").filter("at >= begin and at < end")
    return met.select(F.explode(F.array_repeat("line", F.col("times").cast("int"))).alias("line"))


def two_rounds(rows: DataFrame, sample: DataFrame, least: int, key: str = "ngram") -> DataFrame:
    """``key, round``: keys of more than ``least`` in the sampled documents, then those of the others not done already."""
    first = merge(rows.join(sample, "id_kase", "left_semi"), key).filter(F.col("n") > least).select(key, F.lit(1).alias("round"))
    others = merge(rows.join(sample, "id_kase", "left_anti"), key).filter(F.col("n") > least).select(key, F.lit(2).alias("round"))
    return first.unionByName(others).groupBy(key).agg(F.min("round").alias("round"))
