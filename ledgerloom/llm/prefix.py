"""Distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.session import Workspace


def prefix_sums(work: Workspace, df: DataFrame, groups: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` (whole numbers) within ``groups`` in the order of ``order`` as ``out``; rows of equal order are summed one by one.

    Rows are range-sorted by (groups, order) and written with the number of their range. Sums per range and group, of
    which there is one row for each range that a group touches, give each range its offset, so a group of any size is
    spread over as many ranges as it fills. ``groups`` and ``order`` together should be unique for a defined result.
    """
    cols = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranged = work.table(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum(value).over(W.partitionBy(*groups, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, 0))
    rows = ranged.withColumn("_inside", inside)
    same = [rows[g].eqNullSafe(before[g]) for g in groups] + [rows["_range"] == before["_range"]]
    return rows.join(before, same).select(*[rows[c] for c in df.columns], (rows["_inside"] + before["_before"]).cast("long").alias(out))
