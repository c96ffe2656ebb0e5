"""Property-graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import Workspace


def breadth_first(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of ``starts`` (id), edges taken both ways: id, hop, via, type, confidence of the first edge found.

    ``edges``: edge, source, target, type, confidence. Of the edges that reach a node in the same step, the one from the smaller node, outgoing
    before incoming, with the smaller edge id counts. Each step is one join of the frontier with the edges; nodes that were seen are dropped.
    """
    work = Workspace(spark, "bfs")
    way = lambda a, b, back: edges.select(F.col(a).alias("via"), F.col(b).alias("id"), F.lit(back).alias("back"), "edge", "type", "confidence")
    steps = way("source", "target", 0).unionByName(way("target", "source", 1))
    none = lambda t: F.lit(None).cast(t)
    seen, m = work.write(starts.select("id").distinct().select("id", F.lit(0).alias("hop"), none("bigint").alias("via"), none("string").alias("type"), none("double").alias("confidence")), "seen")
    front, rows = seen, m["rows"]
    for hop in range(1, depth + 1):
        reached = front.select(F.col("id").alias("via")).join(steps, "via").groupBy("id").agg(F.min(F.struct("via", "back", "edge", "type", "confidence")).alias("e"))
        new = lookup_join(reached, seen.select("id", F.lit(True).alias("old")), ["id"]).where("old is null")
        front, m = work.write(new.select("id", F.lit(hop).alias("hop"), F.col("e.via").alias("via"), F.col("e.type").alias("type"), F.col("e.confidence").alias("confidence")), "front")
        if not m["rows"]:
            break
        seen = seen.unionByName(front)
    return seen


def survivors_of_merge(rows: DataFrame, canonical: str = "canonical_id", key: str = "id") -> DataFrame:
    """canonical id, survivor and id of the rows that the smallest id of their canonical id survives; a row each, nothing is gathered."""
    named = rows.where(F.col(canonical).isNotNull()).select(canonical, key)
    least = named.groupBy(canonical).agg(F.min(key).alias("survivor"))
    return lookup_join(named, least, [canonical], "inner").where(F.col(key) != F.col("survivor")).select(canonical, "survivor", key)
