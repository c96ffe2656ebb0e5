"""Features of a data set: vocabulary, labels, splits and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.session import Workspace


def ranked(spark: SparkSession, rows: DataFrame, order: list[Column], name: str, first: int, groups: list[str] = ()) -> DataFrame:
    """``rows`` with their place in a total order (within ``groups``) from ``first`` on, without one task that sorts all rows of a group.

    Rows are range-sorted by (groups, order) and written; the numbers of rows per group and range give each range its offset.
    """
    work = Workspace(spark, "ranked")
    parts = work.table(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_range").alias("_r"), "_before")
    inside = F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_range") == F.col("_r")]
    return parts.withColumn("_inside", inside).join(before, same).select(*rows.columns, (F.col("_inside") + F.col("_before") + (first - 1)).cast("bigint").alias(name))


def vocabulary(spark: SparkSession, tokens: DataFrame, least: int) -> DataFrame:
    """token, n, index of the tokens that occur ``least`` times, most frequent first, from 2 on; 0 is padding and 1 any other token."""
    n = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    fixed = spark.createDataFrame([("<PAD>", 0, 0), ("<UNK>", 0, 1)], "token string, n bigint, index bigint")
    return ranked(spark, n, [F.desc("n"), F.asc("token")], "index", 2).unionByName(fixed)


def label_index(values: DataFrame, column: str) -> DataFrame:
    """Dense indexes from 0 of the sorted distinct labels (few, as labels are)."""
    return values.where(F.col(column).isNotNull()).select(column).distinct().withColumn("index", F.row_number().over(W.orderBy(column)) - 1)


def stratified_split(spark: SparkSession, rows: DataFrame, stratum: str, key: str, test_share: float, seed: int) -> DataFrame:
    """``rows`` with ``part``: of each stratum, in the order of a seeded hash, the first floor(n * (1 - share)) for training, the rest for the test."""
    mixed = rows.withColumn("_mix", F.md5(F.concat_ws("|", F.lit(seed), key)))
    n = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_of"))
    out = ranked(spark, mixed, [F.col("_mix"), F.col(key)], "_place", 1, [stratum]).join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    return out.withColumn("part", F.when(F.col("_place") <= F.floor(F.col("_of") * (1 - test_share) + 1e-9), "train").otherwise("test")).select(*rows.columns, "part")


def quality(rows: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Counts per check and the score: 100 less the weighted share of failures, at least 0. One pass."""
    total = F.count(F.lit(1))
    counts = rows.agg(total.alias("total"), *[F.count_if(c).alias(k) for k, (c, _) in checks.items()])
    lost = sum((F.col(k) * w for k, (_, w) in checks.items()), F.lit(0.0))
    return counts.withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - F.try_divide(lost * 100, F.col("total"))), 4))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def scores(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that is actual or predicted, from the confusion counts (one aggregation of the rows)."""
    c = confusion(pairs)
    role = F.explode(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("p"))))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    per = c.select(hit.alias("hit"), role.alias("r")).groupBy("r.class").agg(F.sum("r.a").alias("support"), F.sum("r.p").alias("predicted"), (F.sum("hit") / 2).alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return per.select("class", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"))
