"""Votes of corrected labels: learned patterns, rules and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_corrections(log: DataFrame) -> DataFrame:
    """The last correction of each content hash (log: hash, at, ...)."""
    rest = [c for c in log.columns if c not in ("hash", "at")]
    return log.groupBy("hash").agg(F.max(F.struct("at", *rest)).alias("r")).select("hash", "r.*")


def pattern_votes(log: DataFrame) -> DataFrame:
    """pattern, category, votes over the whole log; ``patterns`` is an array."""
    return log.select(F.explode("patterns").alias("pattern"), "category").groupBy("pattern", "category").agg(F.count(F.lit(1)).alias("votes"))


def rules(votes: DataFrame, least: int, confidence: float) -> DataFrame:
    """Patterns with enough votes of which enough are for one category (the smaller name on ties)."""
    per = votes.groupBy("pattern").agg(F.sum("votes").alias("total"), F.min(F.struct((-F.col("votes")).alias("v"), "category")).alias("b"))
    share = -F.col("b.v") / F.col("total")
    return per.where((F.col("total") >= least) & (share >= confidence)).select("pattern", F.col("b.category").alias("category"), "total", F.round(share, 4).alias("confidence"))


def suggestions(rows: DataFrame, votes: DataFrame, least: float) -> DataFrame:
    """For rows (id, category, patterns) the category with most votes over all patterns, if it has the share ``least`` and is another one."""
    each = rows.select("id", "category", F.explode("patterns").alias("pattern")).join(votes.withColumnRenamed("category", "to"), "pattern")
    summed = each.groupBy("id", "category", "to").agg(F.sum("votes").alias("votes"))
    best = summed.groupBy("id", "category").agg(F.sum("votes").alias("total"), F.min(F.struct((-F.col("votes")).alias("v"), "to")).alias("b"))
    share = -F.col("b.v") / F.col("total")
    return best.where((share >= least) & ~F.col("b.to").eqNullSafe(F.col("category"))).select("id", "category", F.col("b.to").alias("suggested"), F.round(share, 4).alias("confidence"))
