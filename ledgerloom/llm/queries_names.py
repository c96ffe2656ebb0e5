"""Queries p4: variant spellings of persons and firms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import group_pairs
from ledgerloom.llm.names import classes, variants
from ledgerloom.plans.tables import table


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("normalized_name")).alias("name")
    people = table(spark, d, "people").select(F.lit("person").alias("kind"), "id", name, F.col("email").alias("mail"))
    return people.unionByName(table(spark, d, "companies").select(F.lit("company").alias("kind"), "id", name, F.lit(None).cast("string").alias("mail")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, _names(spark, d)).select(F.col("kind").alias("entity_type"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each row in place of all pairs; rows of one class with clashing middle letters are no pair."""
    return classes(spark, _names(spark, d)).select(F.col("kind").alias("entity_type"), "id", F.col("group").alias("class_id"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each person or firm stands on."""
    groups = group_pairs(spark, variants(spark, _names(spark, d)))
    return groups.groupBy(F.col("kind").alias("entity_type"), F.col("group").alias("group_id")).agg(F.count(F.lit(1)).alias("spellings"))


QUERIES = {f.__name__: f for f in (p4_found, p4_members, p4_groups)}
SQL: dict[str, str] = {}
