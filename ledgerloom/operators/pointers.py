"""Pointer doubling over tables of links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import Workspace


@dataclass(frozen=True)
class Resolved:
    """``ends``: kind, id, root, depth, in_loop[, path] of every linked node; ``loops``: kind, id, root of every node on a loop."""

    ends: DataFrame
    loops: DataFrame


def resolve_pointers(work: Workspace, links: DataFrame, paths: bool = False) -> Resolved:
    """Follow ``links`` (kind, id, ptr; one row per id, no nulls) to their ends.

    Every round joins each open node with the node it points at and doubles the jump, concatenating path segments. As long
    as a chain is open, its open node nearest to the end is resolved in the next round, so after a round that resolves
    nothing all open nodes lead into loops; they have reached them once the jump is as long as there are open nodes.
    A second doubling over the loops' nodes carries the smallest id round each loop.

    ``root`` is the end of the chain, or the smallest id of the loop that it runs into. ``depth`` is the number of links to
    the end; for a node that runs into a loop, the number of links before an id comes a second time. ``path`` lists
    the distinct ids from the node to there. A link to itself is a loop of one. No links give empty results.

    Paths are built in a doubling of their own, after the loops are known: each loop is cut behind its smallest id, so no segment ever goes round
    it, and the part of the loop that is left is added from the loop's one list of ids at the end.
    """
    state, m = _double(work, links, [])
    open_ = state.where(~F.col("done"))
    if not m["open"]:
        loops = state.select("kind", "id", F.col("anc").alias("root")).where("false")
        ring, count = loops, 0
    else:
        ring, count = _smallest_on_loop(work, links, open_.select("kind", F.col("anc").alias("id")).distinct())
    if not paths:
        ends = state.where("done").select("kind", "id", F.col("anc").alias("root"), F.col("dist").alias("depth"), F.lit(False).alias("in_loop"))
        if not count:
            return Resolved(ends, ring)
        round_ = lookup_join(open_, ring.select("kind", F.col("id").alias("anc"), "root"), ["kind", "anc"], "inner", m["open"], count)
        return Resolved(ends.unionByName(round_.select("kind", "id", "root", F.lit(None).cast("long").alias("depth"), F.lit(True).alias("in_loop"))), ring)
    return Resolved(_with_paths(work, links, ring, count, m["rows"]), ring)


def _double(work: Workspace, links: DataFrame, sums: list[str]) -> tuple[DataFrame, dict]:
    """kind, id, anc, dist, done and the columns ``sums`` (numbers are added, arrays concatenated along the way), and the numbers of rows and of open ones.

    ``links`` has kind, id, ptr and the first values of ``sums``.
    """
    add = lambda c: F.concat(c, f"{c}2") if c == "path" else F.col(c) + F.col(f"{c}2")
    sources = links.select("kind", F.col("id").alias("ptr"), F.lit(True).alias("goes_on"))
    first = links.join(sources, ["kind", "ptr"], "left").select("kind", "id", F.col("ptr").alias("anc"), F.lit(1).cast("long").alias("dist"), F.col("goes_on").isNull().alias("done"), *sums)
    metrics = {"rows": F.count(F.lit(1)), "open": F.count_if(~F.col("done"))}
    state, m = work.write(first, "ptr", **metrics)
    jump, before = 1, None
    while m["open"] and (m["open"] != before or jump < m["open"]):
        before = m["open"]
        at = state.select("kind", F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), *[F.col(c).alias(f"{c}2") for c in sums])
        moved = lookup_join(state.where(~F.col("done")), at, ["kind", "anc"], "inner", m["open"], m["rows"]).select(
            "kind", "id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), *[add(c).alias(c) for c in sums]
        )
        old = state
        state, m = work.write(state.where("done").unionByName(moved), "ptr", **metrics)
        work.drop(old)
        jump *= 2
    return state, m


def _with_paths(work: Workspace, links: DataFrame, ring: DataFrame, count: int, rows: int) -> DataFrame:
    """The ends of all linked nodes with their paths; ``ring``: kind, id, root of the ``count`` nodes on loops."""
    on = ring.select("kind", F.col("id").alias("ptr"), F.col("root").alias("loop"))
    tagged = lookup_join(links, on, ["kind", "ptr"], "left", rows, count)
    # a loop is cut behind its smallest id; its link out of there starts the loop's own list
    cut = (F.col("loop") == F.col("id")) if count else F.lit(False)
    forest = tagged.where(~F.coalesce(cut, F.lit(False))).select("kind", "id", "ptr", F.array("ptr").alias("path"), F.col("loop").isNotNull().cast("int").alias("rings"))
    state, m = _double(work, forest, ["path", "rings"])
    ends = state.select("kind", "id", F.col("anc").alias("root"), F.col("dist").alias("depth"), "path", "rings")
    if not count:
        return ends.select("kind", "id", "root", "depth", F.lit(False).alias("in_loop"), "path")
    least = ring.where("id = root").select("kind", "id", "root", F.lit(0).cast("long").alias("depth"), F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("rings"))
    ends = ends.unionByName(least.withColumn("id", F.col("id").cast(links.schema["id"].dataType)))
    first = ring.where("id = root").select("kind", "id").join(links, ["kind", "id"]).select("kind", F.col("id").alias("root"), F.col("ptr").alias("id"))
    # from the id behind the smallest one round to the smallest one
    lists = first.join(ends.select("kind", "id", F.col("path").alias("_p")), ["kind", "id"])
    lists = lists.select("kind", "root", F.when(F.col("id") == F.col("root"), F.array("root")).otherwise(F.concat(F.array("id"), "_p")).alias("round"))
    lists, n = work.write(lists, "rounds", rows=F.count(F.lit(1)))
    mine = ring.select("kind", "id", F.lit(1).alias("self"))
    full = lookup_join(lookup_join(ends, lists, ["kind", "root"], "left", rows, n["rows"]), mine, ["kind", "id"], "left", rows, count)
    left_out = F.size("round") - F.col("rings") - F.coalesce("self", F.lit(0))
    path = F.when(F.col("round").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("round", F.lit(1), F.greatest(left_out, F.lit(0)))))
    return full.select("kind", "id", "root", path.alias("path"), F.col("round").isNotNull().alias("in_loop")).select("kind", "id", "root", F.size("path").cast("long").alias("depth"), "in_loop", "path")


def _smallest_on_loop(work: Workspace, links: DataFrame, on_loop: DataFrame) -> tuple[DataFrame, int]:
    """``on_loop``: the nodes of all loops. Returns kind, id, root (the smallest id of the node's loop) and the number of nodes."""
    start = links.join(on_loop, ["kind", "id"], "left_semi").select("kind", "id", F.col("ptr").alias("anc"), F.col("id").alias("root"))
    ring, m = work.write(start, "loop")
    jump = 1
    while jump < m["rows"]:
        at = ring.select("kind", F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("root").alias("root2"))
        old = ring
        ring, m = work.write(
            lookup_join(ring, at, ["kind", "anc"], "inner", m["rows"], m["rows"]).select("kind", "id", F.col("anc2").alias("anc"), F.least("root", "root2").alias("root")), "loop"
        )
        work.drop(old)
        jump *= 2
    return ring.select("kind", "id", "root"), m["rows"]
