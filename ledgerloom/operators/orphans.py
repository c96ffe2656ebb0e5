"""References to records that do not exist, kept as incremental pending-orphan state."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import Workspace, empty

REFS = "ref_field string, parent string, child string, ref_key string, key string, at timestamp_ntz"
ARRIVALS = "parent string, key string, at timestamp_ntz"


def clean_key(c: Column) -> Column:
    """Lower case without outer white space; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(c), r"^[\s\u00a0]+|[\s\u00a0]+$", ""), F.lit(""))


#: From so many segments on the parent index is merged into one.
COMPACT = 8


@dataclass(frozen=True)
class OrphanState:
    """What is kept between batches.

    ``index``: segments, one of each batch, of parent, key, since (earliest arrival, null if no arrival has a time), last, gone (latest
    deletion), unique by parent and key in each; ``index_rows``: rows per parent in all of them.
    ``waiting``: orphans whose parent never came (or was deleted): ref_field, parent, child, ref_key, key, at, reason.
    ``resolved``: orphans whose parent came later, with ``resolved_at``.
    ``held``: references that found their parent, kept only if deletions are to reopen them.
    """

    index: tuple[DataFrame, ...]
    waiting: DataFrame
    resolved: DataFrame
    held: tuple[DataFrame, ...]
    index_rows: dict[str, int]
    waiting_rows: int


def merged(segments: tuple[DataFrame, ...], parent: str) -> DataFrame:
    """key, since, last, gone of one parent over all segments, unique by key."""
    rows = reduce(DataFrame.unionByName, segments).where(F.col("parent") == parent)
    if len(segments) == 1:
        return rows.select("key", "since", "last", "gone")
    return rows.groupBy("key").agg(F.min("since").alias("since"), F.max("last").alias("last"), F.max("gone").alias("gone"))


class OrphanTracker:
    """Batches of references, arriving parents and deletions, in the order of time, against one state.

    A new reference probes the parent index and waits if its parent is not there, or not yet there at its own time.
    An arriving parent resolves the references that wait for it; a deletion reopens those that point at it.
    References with a null key are none. Those without a time count as made when their batch ends, so a parent of any time holds for
    them; so do arrivals without a time, which hold only where no arrival of the key has one. Repeated rows are
    one reference. References, arrivals and deletions of a batch may each be empty or None.

    A batch writes its own arrivals as a segment of the index and never rewrites older ones (they are merged when they get many);
    what waits is joined with that segment only. With ``deletions``, references that found their parent are kept too,
    so that a later deletion reopens them without the history being read again.
    """

    def __init__(self, spark: SparkSession, parents: list[str], deletions: bool = False):
        self.spark, self.parents, self.deletions = spark, parents, deletions
        self.work = Workspace(spark, "orphans")
        waiting, resolved = (empty(spark, REFS + x) for x in (", reason string", ", reason string, resolved_at timestamp_ntz"))
        self.state = OrphanState((), waiting, resolved, (), dict.fromkeys(parents, 0), 0)

    def advance(
        self, refs: DataFrame | None, arrivals: DataFrame | None, deletions: DataFrame | None = None, history: DataFrame | None = None, refs_rows: int | None = None
    ) -> OrphanState:
        """Take a batch: ``refs`` as REFS, ``arrivals`` and ``deletions`` as ARRIVALS.

        ``history``: all references made so far, in place of those that the tracker kept; ``refs_rows``: the number of references, if it was counted,
        so that hot keys of large batches are split.
        """
        old, spark = self.state, self.spark
        refs = empty(spark, REFS) if refs is None else refs.where("key is not null")
        segment, sizes = self._segment(arrivals, deletions)
        index, rows = (*old.index, segment), {p: old.index_rows[p] + sizes[p] for p in self.parents}
        opened = self._probe(refs, index, rows, refs_rows)
        if self.deletions:
            opened = self.work.table(opened, "probed")
            held = (*old.held, opened.where("reason is null").select(*refs.columns))
            opened = opened.where("reason is not null")
        else:
            held, opened = (), opened.where("reason is not null")
        never = "cast(null as timestamp_ntz) as resolved_at"
        if deletions is not None and (history is not None or old.held):
            lost = segment.where("gone is not null and (last is null or last <= gone)").select("parent", "key", "gone")
            before = [history.where("key is not null")] if history is not None else [*old.held, old.resolved]
            again = reduce(DataFrame.unionByName, [b.select(*refs.columns) for b in before]).join(lost, ["parent", "key"]).where("at is null or at < gone")
            opened = opened.unionByName(again.selectExpr(*refs.columns, "'deleted' as reason", never))
        # what waited may have come with this batch
        came = segment.selectExpr("parent", "key", "if(last > gone, last, since) as resolved_at", "gone", "true as there")
        still = lookup_join(old.waiting, came, ["parent", "key"], "left", old.waiting_rows, sum(sizes.values()))
        still = still.selectExpr(*old.waiting.columns, "resolved_at", "coalesce(there and (gone is null or resolved_at > gone), false) as back").where("not back or resolved_at is not null")
        both = opened.unionByName(still.selectExpr(*old.waiting.columns, "if(back, resolved_at, null) as resolved_at"))
        both, m = self.work.write(both.distinct(), "orphans", waiting=F.count_if(F.col("resolved_at").isNull()))
        if len(index) >= COMPACT:
            whole = reduce(DataFrame.unionByName, [merged(index, p).select(F.lit(p).alias("parent"), "key", "since", "last", "gone") for p in self.parents])
            whole, rows = self.work.write(whole, "index", **self._count())
            self.work.drop(*index)
            index = (whole,)
        self.state = OrphanState(index, both.where("resolved_at is null").drop("resolved_at"), old.resolved.unionByName(both.where("resolved_at is not null")), held, rows, m["waiting"])
        return self.state

    def _count(self) -> dict:
        return {p: F.count_if(F.col("parent") == p) for p in self.parents}

    def _segment(self, arrivals: DataFrame | None, deletions: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
        none = "cast(null as timestamp_ntz)"
        rows = (empty(self.spark, ARRIVALS) if arrivals is None else arrivals).selectExpr("parent", "key", "at", f"{none} as gone")
        if deletions is not None:
            rows = rows.unionByName(deletions.selectExpr("parent", "key", f"{none} as at", "at as gone"))
        found = rows.where("key is not null").groupBy("parent", "key").agg(F.min("at").alias("since"), F.max("at").alias("last"), F.max("gone").alias("gone"))
        return self.work.write(found, "segment", **self._count())

    def _probe(self, refs: DataFrame, index: tuple[DataFrame, ...], rows: dict[str, int], refs_rows: int | None) -> DataFrame:
        """The references of a batch with the reason why they are orphans, null if they are none, and the time when the parent came if it has come by now."""
        lost = "gone is not null and (last is null or last <= gone)"
        reason = f"case when there is null then 'missing' when {lost} then 'deleted' when at < since then 'early' when at >= gone and at < last then 'deleted' end as reason"
        came = f"case when reason = 'early' then since when reason = 'deleted' and not ({lost}) then last end as resolved_at"
        parts = []
        for p in self.parents:
            joined = lookup_join(refs.where(F.col("parent") == p), merged(index, p).withColumn("there", F.lit(True)), ["key"], "left", refs_rows, rows[p])
            parts.append(joined.selectExpr("*", reason).selectExpr(*refs.columns, "reason", came))
        return reduce(DataFrame.unionByName, parts)
