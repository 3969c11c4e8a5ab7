"""Term matrices as coordinate rows: TF-IDF, co-occurrence, association scores.

Lines are short contexts, ``period, line, w``: a text that occurs ``w`` times.
The weight stands for repetition, so repeated lines are one row.  Pairs are made
inside the row of a line, whose length is bounded by what a line is; no self-join,
no shuffle before the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_terms(lines: DataFrame, vocabulary: DataFrame | None, tokens: Column) -> DataFrame:
    """``period, line_id, w, terms``: term frequencies of each line, an array of (term, tf). Lines without one keep an empty array."""
    per = lines.groupBy("period", "line").agg(F.sum("w").alias("w"))
    if vocabulary is None:  # within the row
        found = per.withColumn("tokens", tokens)
        count = lambda t: F.size(F.filter("tokens", lambda x: x == t)).cast("bigint")
        terms = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), count(t).alias("tf")))
        return found.select("period", "line", "w", F.array_sort(terms).alias("terms"))
    exploded = per.select("period", "line", "w", F.explode_outer(tokens).alias("term"))
    known = vocabulary.select("term", F.lit(True).alias("known"))
    exploded = exploded.join(known, "term", "left").withColumn("term", F.when(F.col("known"), F.col("term"))).drop("known")
    counted = exploded.groupBy("period", "line", "w", "term").agg(F.count("*").alias("tf"))
    terms = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return counted.groupBy("period", "line", "w").agg(F.array_sort(terms).alias("terms"))


def tfidf(lines: DataFrame, normalise: bool = True) -> DataFrame:
    """``period, line, w, term, tf, value`` of ``line_terms``: tf * (ln((1 + N) / (1 + df)) + 1), rows scaled to length 1 if asked."""
    sizes = lines.groupBy("period").agg(F.sum("w").alias("n_lines"))
    rows = lines.select("period", "line", "w", F.explode("terms").alias("t")).select("period", "line", "w", "t.term", "t.tf")
    df = rows.groupBy("period", "term").agg(F.sum("w").alias("df"))
    idf = df.join(F.broadcast(sizes), "period").select("period", "term", (F.log((1.0 + F.col("n_lines")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    valued = rows.join(idf, ["period", "term"]).withColumn("value", F.col("tf") * F.col("idf"))
    if not normalise:
        return valued.select("period", "line", "w", "term", "tf", "value")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy("period", "line")))
    return valued.select("period", "line", "w", "term", "tf", (F.col("value") / norm).alias("value"))


def cooccurrence(valued: DataFrame) -> DataFrame:
    """``period, row, col, value``: sum over lines of w * x_row * x_col, both triangles and the diagonal.

    Only one triangle is made and shuffled; the other is its mirror.
    """
    per = valued.groupBy("period", "line", "w").agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("terms"))
    # two generators in a row, so the pairs of a long line are made one after another and never held together
    first = per.select("period", "w", "terms", F.posexplode("terms").alias("i", "a"))
    pairs = first.select("period", "w", "a", F.explode(F.slice("terms", F.col("i") + 1, F.size("terms"))).alias("b"))
    each = pairs.select("period", "w", F.struct(F.col("a.term").alias("row"), F.col("b.term").alias("col"), (F.col("a.value") * F.col("b.value")).alias("x")).alias("p"))
    half = each.groupBy("period", F.col("p.row").alias("row"), F.col("p.col").alias("col")).agg(F.sum(F.col("w") * F.col("p.x")).alias("value"))
    both = F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col")))
    cells = F.explode(F.when(F.col("row") == F.col("col"), F.slice(both, 1, 1)).otherwise(both)).alias("c")
    return half.select("period", cells, "value").select("period", "c.row", "c.col", "value")


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select("period", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def filled(matrix: DataFrame, terms: list[str], value: str = "value") -> DataFrame:
    """``period, row, col, value`` of all pairs of the chosen terms, 0 where there is none. The terms are a parameter."""
    listed = matrix.sparkSession.createDataFrame([(t,) for t in terms], "row string")
    periods = matrix.select("period").distinct()
    scaffold = periods.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(listed.withColumnRenamed("row", "col")))
    held = matrix.filter(F.col("row").isin(terms) & F.col("col").isin(terms)).select("period", "row", "col", value)
    return scaffold.join(held, ["period", "row", "col"], "left").select("period", "row", "col", F.coalesce(value, F.lit(0.0)).alias("value"))


def dense(rows: DataFrame, document: str, terms: list[str], key: str = "term", value: str = "n") -> DataFrame:
    """One row per document and a column for each of the chosen terms; 0 where it is absent."""
    held = rows.withColumn(key, F.when(F.col(key).isin(terms), F.col(key)))
    return held.groupBy(document).pivot(key, terms).agg(F.sum(value)).fillna(0, subset=terms)


def pmi_k(matrix: DataFrame, k: int = 2) -> DataFrame:
    """``period, row, col, pmi``: ln(c^k / (c_row c_col)); pairs that never occur have no row."""
    diagonal = matrix.filter("row = col").select("period", F.col("row").alias("t"), F.col("value").alias("d"))
    with_row = matrix.filter("value > 0").join(diagonal.select("period", F.col("t").alias("row"), F.col("d").alias("d_row")), ["period", "row"])
    both = with_row.join(diagonal.select("period", F.col("t").alias("col"), F.col("d").alias("d_col")), ["period", "col"])
    return both.select("period", "row", "col", F.log(F.pow(F.col("value").cast("double"), F.lit(k)) / (F.col("d_row") * F.col("d_col"))).alias("pmi"))


def pmi_normalised(scores: DataFrame) -> DataFrame:
    """Scores scaled per period: missing pairs would be 0, the least present one .5, the greatest and the diagonal 1."""
    ends = scores.groupBy("period").agg(F.min("pmi").alias("lo"), F.max("pmi").alias("hi"))
    low = F.col("lo") - F.abs(F.col("hi") - F.col("lo"))
    scaled = F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.try_divide(F.col("pmi") - low, F.col("hi") - low))
    return scores.join(F.broadcast(ends), "period").select("period", "row", "col", scaled.alias("value"))


def column_maximum(matrix: DataFrame) -> DataFrame:
    """Each column divided by its greatest value; null where that is 0."""
    top = F.max("value").over(W.partitionBy("period", "col"))
    return matrix.select("period", "row", "col", F.try_divide(F.col("value").cast("double"), top.cast("double")).alias("value"))


def association_ranks(matrix: DataFrame, vocabulary: DataFrame, of: list[str]) -> DataFrame:
    """``period, col, row, rank``: the place, from 0, of every term of the vocabulary in the column of each term of ``of``.

    Absent pairs count as 0; ties are in order of the term.
    """
    spark = matrix.sparkSession
    columns = spark.createDataFrame([(c,) for c in of], "col string")
    periods = matrix.select("period").distinct()
    asked = F.broadcast(periods.crossJoin(F.broadcast(columns)))  # chosen columns only
    scaffold = vocabulary.select(F.col("term").alias("row")).crossJoin(asked)
    filled = scaffold.join(matrix.filter(F.col("col").isin(of)), ["period", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    order = W.partitionBy("period", "col").orderBy(F.desc(F.round("value", 9)), "row")
    return filled.select("period", "col", "row", (F.row_number().over(order) - 1).alias("rank"))
