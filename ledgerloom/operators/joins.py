"""Joins against a side with unique keys that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 20_000
#: From this many rows on the left, keys are counted to find hot ones.
HOT_FROM_ROWS = 1_000_000
#: A key is hot that has at least this share of the left rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000
#: The rows of a hot key are spread over so many pieces, each with a copy of the key's right row.
SALTS = 32


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    left_rows: int | None = None,
    right_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, whose ``keys`` are unique.

    A right side counted to be small is broadcast. Otherwise both sides are shuffled by key; when the left side is large,
    its hot keys are counted first, and in the one shuffled join their left rows are salted and their right rows (at most ``1 / HOT_SHARE``)
    repeated per salt, so that no task has to take all rows of one key. The salt comes from the row and its map task, which a retried
    task gives again. Rows whose key is null match nothing.
    """
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    if left_rows is None or left_rows < HOT_FROM_ROWS:
        return left.join(right, keys, how)
    heavy = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") >= max(1, int(left_rows * HOT_SHARE))) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        .select(*keys, F.lit(True).alias("_hot"))
    )
    tagged = lambda df: df.join(F.broadcast(heavy), keys, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    pieces = tagged(right).withColumn("_salt", F.explode(copies)).drop("_hot")
    return tagged(left).withColumn("_salt", salt).drop("_hot").join(pieces, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores before costly per-row work, if its scan has fewer partitions than there are cores (and so is small)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
