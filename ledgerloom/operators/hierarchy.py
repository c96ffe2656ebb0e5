"""Parent-child links to full hierarchies: path, depth, root, descendants and loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.pointers import resolve_pointers
from ledgerloom.session import Workspace


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: kind, id, root, depth, in_loop, linked[, path]; ``loops``: kind, id, root."""

    nodes: DataFrame
    loops: DataFrame

    def descendants(self) -> DataFrame:
        """kind, id, descendant, distance: a row for every node below another (needs paths).

        It has one row for each pair, spread over the descendants; nothing is gathered per root.
        """
        return self.nodes.where("linked").select("kind", F.col("id").alias("descendant"), F.posexplode("path").alias("pos", "id")).where(
            F.col("id") != F.col("descendant")
        ).select("kind", "id", "descendant", (F.col("pos") + 1).cast("long").alias("distance"))


def hierarchy(spark: SparkSession, rows: DataFrame, paths: bool = False) -> Hierarchy:
    """Hierarchies of ``rows`` (kind string, id bigint, parent bigint; further columns are ignored).

    Rows with a null id are left out. If an id stands on several rows with different parents, the smallest parent holds.
    A parent that has no row itself ends the chain at the last existing row. Empty input gives empty results.
    """
    work = Workspace(spark, "hierarchy")
    one = rows.where("id is not null").groupBy("kind", "id").agg(F.min("parent").alias("parent"))
    nodes = work.table(one.select("kind", "id", "parent"), "nodes")
    there = nodes.select("kind", F.col("id").alias("ptr"))
    links = work.table(nodes.where("parent is not null").select("kind", "id", F.col("parent").alias("ptr")).join(there, ["kind", "ptr"], "left_semi"), "links")
    found = resolve_pointers(work, links, paths)
    path = [F.coalesce("path", F.array().cast("array<bigint>")).alias("path")] if paths else []
    out = nodes.join(found.ends, ["kind", "id"], "left").select(
        "kind",
        "id",
        F.coalesce("root", "id").alias("root"),
        F.when(F.col("root").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth")).alias("depth"),
        F.coalesce("in_loop", F.lit(False)).alias("in_loop"),
        F.col("parent").isNotNull().alias("linked"),
        *path,
    )
    return Hierarchy(out, found.loops)
