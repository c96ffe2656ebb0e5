"""Best representative of each duplicate group by iterative truth discovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import Workspace


@dataclass(frozen=True)
class Field:
    """A field whose value is to be found.

    ``usable``: whether the row's value can be true at all. ``order``: whole numbers that rank a row's value before any vote; only
    values of the highest rank in their group can win, and votes decide among those. Without an order votes decide alone, with one
    that ends in the negated row id nothing is left to them. All usable values vote on the reliability of sources in any case.
    """

    name: str
    value: Column
    usable: Column
    order: Column | tuple[Column, ...] | None = None

    def ranks(self) -> list[Column]:
        return [] if self.order is None else list(self.order) if isinstance(self.order, tuple) else [self.order]


def discover(spark: SparkSession, rows: DataFrame, group: Column, row_id: Column, source: Column, fields: list[Field], tolerance: float = 1e-3, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """The highest-supported value per group and field, and the reliability of each source.

    Returns (group, field, row_id, value, support) and (source, weight). ``source`` is a text or an array of texts. Every usable value of a
    row is a claim of each of the row's sources. Rounds alternate: the support of a claimed value is the weight of the claims for it, as a share of
    all weight claimed for that group and field; the weight of a source is the mean support of its claims. They end when no weight
    moves by more than ``tolerance``; if that isn't so after ``rounds``, a RuntimeError tells it. Among the values of the highest rank (see
    ``Field``) the one with most support wins; ties go to the smaller row id. Rows without a group are left
    out, a null source and no source are one source of their own, groups without a usable value for a field have no row for it.

    Claims are counted per (group, field, value, source) once, so repeated rows are pre-aggregated, and no group has to fit into one task.
    """
    work = Workspace(spark, "survivors")
    if not isinstance(rows.select(source.alias("s")).schema["s"].dataType, T.ArrayType):
        source = F.array(source)
    sources = F.array_distinct(F.transform(source, lambda x: F.coalesce(x, F.lit(""))))
    rank = lambda f: F.array(*[F.coalesce(r.cast("long"), F.lit(-(2**62))) for r in f.ranks()]).cast("array<bigint>")
    claim = F.array(*[F.when(F.coalesce(f.usable, F.lit(False)), F.struct(F.lit(f.name).alias("field"), f.value.cast("string").alias("value"), rank(f).alias("ord"))) for f in fields])
    claims = rows.select(group.alias("grp"), row_id.cast("long").alias("row_id"), F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(""))).alias("srcs"), F.explode(F.array_compact(claim)).alias("c"))
    claims = claims.where("grp is not null").select("grp", F.explode("srcs").alias("src"), "c.field", "c.value", F.struct("c.ord", (-F.col("row_id")).alias("first")).alias("best"))
    key = ["grp", "field", "value"]
    counted, m = work.write(claims.groupBy(*key, "src").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best")), "claims", rows=F.count(F.lit(1)))
    weights, w = work.write(counted.select("src").distinct().withColumn("weight", F.lit(0.5)), "weights", rows=F.count(F.lit(1)))
    for _ in range(rounds):
        support = _support(counted, weights, key, m["rows"], w["rows"])
        new = counted.join(support, [*key]).groupBy("src").agg(F.greatest(F.sum(F.col("support") * F.col("n")) / F.sum("n"), F.lit(0.01)).alias("weight"))
        joined = lookup_join(new, weights.withColumnRenamed("weight", "old"), ["src"], "inner", w["rows"], w["rows"])
        old = weights
        weights, moved = work.write(joined, "weights", moved=F.max(F.abs(F.col("weight") - F.col("old"))))
        weights = weights.drop("old")
        work.drop(old)
        if moved["moved"] is None or moved["moved"] <= tolerance:
            break
    else:
        raise RuntimeError(f"weights of sources still move by {moved['moved']} after {rounds} rounds")
    ranked = counted.groupBy(*key).agg(F.max("best").alias("best")).join(_support(counted, weights, key, m["rows"], w["rows"]), key)
    best = ranked.groupBy("grp", "field").agg(F.max(F.struct("best.ord", "support", "best.first", "value")).alias("w"))
    return best.select("grp", "field", (-F.col("w.first")).alias("row_id"), F.col("w.value").alias("value"), F.col("w.support").alias("support")), weights


def _support(counted: DataFrame, weights: DataFrame, key: list[str], claims: int, sources: int) -> DataFrame:
    # sums of weight times count as decimals: equal backing gives equal support in any order of summing
    w = weights.select("src", F.col("weight").cast(T.DecimalType(12, 9)).alias("weight"))
    got = lookup_join(counted, w, ["src"], "inner", claims, sources).groupBy(*key).agg(F.sum(F.col("weight") * F.col("n")).alias("weight"))
    total = got.groupBy("grp", "field").agg(F.sum("weight").alias("all_weight"))
    return lookup_join(got, total, ["grp", "field"], "inner", claims).select(*key, (F.col("weight").cast("double") / F.col("all_weight").cast("double")).alias("support"))
