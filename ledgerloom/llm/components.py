"""Connected components by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.joins import lookup_join
from ledgerloom.operators.pointers import resolve_pointers
from ledgerloom.session import Workspace


def group_pairs(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """One group for all records that ``pairs`` (kind string, a bigint, b bigint; further columns are ignored) join directly or through others.

    Returns kind, id, group: the smallest id of the group, for each id in a group of two or more. Pairs with a null side
    or of an id with itself join nothing; repeated pairs count once; no pairs give no rows.

    Each round, every component hooks itself onto its smallest neighbour, which is its smallest outgoing edge in the order of
    (smaller end, larger end). Of two that choose each other the smaller stays the root, and as edges get smaller along every
    chain of choices, that root is the smallest id of its tree. Trees collapse by pointer doubling; edges are
    relabelled and deduplicated until none is left. Components at least halve, so all rounds' maps together are no longer
    than twice the nodes; they are composed from the last to the first.
    """
    work = Workspace(spark, "groups")
    count = {"rows": F.count(F.lit(1))}
    both = pairs.where("a is not null and b is not null and a <> b").select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, m = work.write(both, "edges", **count)
    maps: list[tuple[DataFrame, int]] = []
    while m["rows"]:
        ends = edges.select("kind", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("ptr")), F.struct(F.col("b").alias("id"), F.col("a").alias("ptr")))).alias("e")).select("kind", "e.*")
        choice, n = work.write(ends.groupBy("kind", "id").agg(F.min("ptr").alias("ptr")), "choice", **count)
        other = choice.select("kind", F.col("id").alias("ptr"), F.col("ptr").alias("back"))
        links = work.table(
            lookup_join(choice, other, ["kind", "ptr"], "inner", n["rows"], n["rows"]).where(~((F.col("back") == F.col("id")) & (F.col("id") < F.col("ptr")))).select("kind", "id", "ptr"), "links"
        )
        trees, k = work.write(resolve_pointers(work, links).ends.select("kind", "id", "root"), "trees", **count)
        maps.append((trees, k["rows"]))
        old, before = edges, m["rows"]
        for side in ("a", "b"):
            to = trees.select("kind", F.col("id").alias(side), F.col("root").alias("to"))
            edges = lookup_join(edges, to, ["kind", side], "left", before, k["rows"]).withColumn(side, F.coalesce("to", side)).drop("to")
        edges = edges.where("a <> b").select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges, m = work.write(edges, "edges", **count)
        work.drop(old, choice, links)
    if not maps:
        return both.select("kind", F.col("a").alias("id"), F.col("b").alias("group")).where("false")
    final, rows = maps[-1]
    for trees, k in reversed(maps[:-1]):
        up = final.select("kind", F.col("id").alias("root"), F.col("root").alias("top"))
        moved = lookup_join(trees, up, ["kind", "root"], "left", k, rows).select("kind", "id", F.coalesce("top", "root").alias("root"))
        # a root of this round that a later round hooked on is in `final` itself
        final, r = work.write(moved.unionByName(final), "composed", **count)
        rows = r["rows"]
    roots = final.select("kind", F.col("root").alias("id"), "root").distinct()
    return final.unionByName(roots).select("kind", "id", F.col("root").alias("group")).distinct()
