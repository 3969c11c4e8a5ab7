"""Queries over names (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexichron.llm.names import name_entities, name_pairs
from lexichron.session import table, written


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a scholar or institution with the entity it names."""
    creators = table(spark, sf_dir, "metadata_df").select(F.explode("creator").alias("name"))
    entries = table(spark, sf_dir, "entries_df").select(F.col("`dc:creator`").alias("name"))
    return name_entities(creators.unionByName(entries))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(written(p3_entities(spark, sf_dir), "name-entities"))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict = {}
