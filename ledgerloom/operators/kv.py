"""A key-value table with namespaces and expiry as operators on (namespace, key, value, expires_at, at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(log: DataFrame, order: list[str]) -> DataFrame:
    """The table that a log of writes leaves: the last write of each key."""
    rest = [c for c in log.columns if c not in ("namespace", "key", *order)]
    best = log.groupBy("namespace", "key").agg(F.max(F.struct(*order, *rest)).alias("w"))
    return best.select("namespace", "key", *[F.col(f"w.{c}").alias(c) for c in (*order, *rest)])


def alive(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= now)


def get(table: DataFrame, namespace: str, keys: list[str], now: Column) -> DataFrame:
    return table.where((F.col("namespace") == namespace) & F.col("key").isin(keys) & alive(now))


def remaining(now: Column) -> Column:
    """Seconds to live: -1 for ever, 0 when expired."""
    left = F.unix_timestamp(F.col("expires_at").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    return F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(F.greatest(left, F.lit(0)))


def kind(value: Column) -> Column:
    """bool before int before float; quoted texts are strings, the rest is JSON."""
    return (
        F.when(value.isin("true", "false"), "bool")
        .when(value.rlike(r"^-?\d+$"), "int")
        .when(value.rlike(r"^-?\d+\.\d+([eE][-+]?\d+)?$"), "float")
        .when(value.rlike(r"^[\[{]"), "json")
        .otherwise("string")
    )


def increment(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters (namespace, key, value) with all deltas added; new keys start at 0."""
    add = deltas.groupBy("namespace", "key").agg(F.sum("delta").alias("delta"))
    return counters.join(add, ["namespace", "key"], "full").select("namespace", "key", (F.coalesce("value", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("value"))


def hash_fields(table: DataFrame, now: Column) -> DataFrame:
    """Composite keys ``name:field`` as one map per namespace and name; the value of an expired field is null."""
    pair = F.struct(F.substring_index("key", ":", -1).alias("field"), F.when(alive(now), F.col("value")).alias("value"))
    name = F.regexp_extract("key", "^(.*):[^:]*$", 1).alias("name")
    return table.where(F.col("key").contains(":")).groupBy("namespace", name).agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("fields"))


def delete(table: DataFrame, namespace: str, keys: list[str]) -> DataFrame:
    return table.where(~((F.col("namespace") == namespace) & F.col("key").isin(keys)))


def flush(table: DataFrame, namespace: str | None = None) -> DataFrame:
    """Without the keys of a namespace, or of all."""
    return table.where(F.lit(False)) if namespace is None else table.where(F.col("namespace") != namespace)


def expire(table: DataFrame, namespace: str, keys: list[str], until: Column | None) -> DataFrame:
    """Keys with an end of life, or, with None, without one (persist)."""
    hit = (F.col("namespace") == namespace) & F.col("key").isin(keys)
    return table.withColumn("expires_at", F.when(hit, F.lit(None).cast("timestamp_ntz") if until is None else until).otherwise(F.col("expires_at")))


def fields(table: DataFrame, namespace: str, name: str, now: Column) -> DataFrame:
    """The fields of a hash, a row each (hgetall without one map for all): field, value of those alive."""
    own = table.where((F.col("namespace") == namespace) & F.col("key").startswith(f"{name}:") & alive(now))
    return own.select(F.substring(F.col("key"), F.lit(len(name) + 2), F.length("key")).alias("field"), "value")


def set_fields(table: DataFrame, namespace: str, name: str, new: DataFrame) -> DataFrame:
    """``table`` with the fields (field, value) of a hash set; other columns of new rows are null, older values of the same fields go."""
    rows = new.select(F.lit(namespace).alias("namespace"), F.concat(F.lit(f"{name}:"), "field").alias("key"), "value")
    return table.join(rows.select("namespace", "key"), ["namespace", "key"], "left_anti").unionByName(rows, allowMissingColumns=True)
