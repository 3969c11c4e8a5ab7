"""Queries over tokens of public tokenizers (problems 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm.packing import pack
from lexichron.llm.tokens import decode, encode, token_counts
from lexichron.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), offsets=True)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as they come back from their ids; null texts come back empty."""
    return decode(encode(table(spark, sf_dir, "documents")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container, for each capacity."""
    documents, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits")
    named = [r[0] for r in limits.select("tokenizer").distinct().collect()]  # a fixed table of three rows
    sized = None
    for name in sorted(named):
        part = token_counts(documents, name).withColumn("tokenizer", F.lit(name))
        sized = part if sized is None else sized.unionByName(part)
    items = sized.join(F.broadcast(limits), "tokenizer").select("limit_id", "capacity", "doc_id", "n_tokens")
    return pack(items, documents.count())


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: tokens, containers, the fewest containers there could be, and the share of room used."""
    packed = p8_packed(spark, sf_dir)
    used = packed.groupBy("limit_id", "capacity").agg(
        F.sum("n_tokens").alias("tokens"), F.countDistinct("container").alias("containers")
    )
    return used.select(
        "limit_id",
        "capacity",
        "tokens",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"),
    )


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tokens of each text cover: where the first begins, the last ends, and how many characters lie between two of them."""
    gaps = F.aggregate(F.zip_with(F.col("starts"), F.col("before"), lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda x, y: x + y)
    spans = p7_offsets(spark, sf_dir).withColumn("before", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))))
    held = F.size("ids") > 0
    return spans.select("doc_id", F.when(held, F.get("starts", F.lit(0))).alias("begin"), F.when(held, F.array_max("ends")).alias("last"), F.when(held, gaps).alias("gaps"))


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, documents in pieces without need or with a token lost or twice, containers that are overfull."""
    packed = p8_packed(spark, sf_dir)
    key = ["limit_id", "capacity"]
    of_document = packed.groupBy(*key, "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("first_token").alias("begins")
    )
    wrong = (F.col("end") != F.col("n")) | (F.col("begins") != F.col("pieces")) | (F.col("pieces") > F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)))
    documents = of_document.groupBy(*key).agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong"))
    filled = packed.groupBy(*key, "container").agg(F.sum("n_tokens").alias("n"))
    return documents.join(filled.groupBy(*key).agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull")), key)


QUERIES = {"p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_decoded": p7_decoded, "p7_spans": p7_spans, "p8_packed": p8_packed, "p8_use": p8_use, "p8_sound": p8_sound}

#: No SQL encodes byte pairs; decoding is (the text, or the empty text), and so is what must hold of any encoding and packing.
SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_spans": "SELECT doc_id, CASE WHEN text <> '' THEN 0 END AS begin, CASE WHEN text <> '' THEN length(text) END AS last, CASE WHEN text <> '' THEN 0 END AS gaps FROM documents",
    "p8_sound": "SELECT limit_id, capacity, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS wrong, 0 AS overfull FROM pack_limits",
}
