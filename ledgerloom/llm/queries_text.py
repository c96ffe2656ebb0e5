"""Queries on texts: p7 (leaked test items), p8 (mixing of sources), p9 (texts cut off)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.cuts import cut_documents
from ledgerloom.llm.leaks import cleaned, leaked
from ledgerloom.llm.mixing import mix
from ledgerloom.plans.tables import table


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return leaked(spark, table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item the documents that hold it and the largest share of it that one holds."""
    return _passages(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("coverage"), 4).alias("coverage"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold passages of test items, without them: text, number of spans and of characters removed."""
    return cleaned(spark, table(spark, d, "documents"), _passages(spark, d))


def _source(c: str = "source") -> F.Column:
    return F.nullif(F.replace(F.trim(F.lower(c)), F.lit("-"), F.lit("_")), F.lit(""))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", _source().alias("source"), "text")
    return mix(spark, docs, table(spark, d, "mix_targets").withColumn("source", _source()))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, d)[0]


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source is used and the share that it reaches."""
    return _mix(spark, d)[1]


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return cut_documents(spark, table(spark, d, "documents").select("doc_id", _source().alias("source"), "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts, by reason."""
    docs = table(spark, d, "documents").where("text is not null").groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    cut = _cuts(spark, d).groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("cut"), F.count_if(F.col("reason") == "limit").alias("at_limit"))
    joined = docs.join(cut, docs.source.eqNullSafe(cut.s), "left").fillna(0, ["cut", "at_limit"])
    return joined.select("source", "documents", "cut", "at_limit", F.round(F.col("cut") / F.col("documents"), 4).alias("rate"))


QUERIES = {f.__name__: f for f in (p7_found, p7_items, p7_cleaned, p8_mix, p8_sources, p9_found, p9_rates)}
SQL: dict[str, str] = {}
