"""Catalog operators: current rows, upserts, filters, search, paging, top rows per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.operators.features import ranked

#: A name without its last suffix, and that suffix.
NAME = r"(?s)^(.+?)((?:\.[^.]*)?)$"


def latest(rows: DataFrame, keys: list[str], order: list[str], total: bool = True) -> DataFrame:
    """One row per key: the greatest in ``order`` (nulls least), then, if ``total``, in all other columns.

    Without ``total``, rows equal in the keys and in ``order`` have to be deliveries of one state; only the columns that a
    query uses are then read, since column pruning and filters on the keys go through the window. Its limit of one row drops
    older rows before the shuffle, so a key of any size is no burden to one task.
    """
    ranks = [*order, *([c for c in rows.columns if c not in keys and c not in order] if total else [])]
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in ranks])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key, except columns in ``keep_old``, whose old values stay if not null.

    ``changes`` has one row per key. A column that changes don't have stays as it was.
    """
    both = [c for c in base.columns if c in changes.columns and c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in both], F.lit(True).alias("_hit"))
    joined = base.join(new, keys, "full")
    pick = lambda c: F.coalesce(c, f"_n_{c}") if c in keep_old else F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*[F.col(c) if c not in both else pick(c).alias(c) for c in base.columns])


def get_or_create(base: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``base`` with a row for each new value of ``key`` in ``names``."""
    return base.unionByName(names.select(key).where(F.col(key).isNotNull()).distinct().join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of ``columns`` in whatever case; % and _ are wildcards; no columns give no rows."""
    found = [F.col(c).ilike(f"%{text}%") for c in columns]
    return rows.where(reduce(lambda a, b: a | b, found)) if found else rows.where(F.lit(False))


def glob_filter(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """``*`` and ``?`` in whatever case; a lone ``*`` keeps all."""
    return rows if pattern == "*" else rows.where(F.col(column).ilike(pattern.replace("*", "%").replace("?", "_")))


def in_box(rows: DataFrame, lat: float, lon: float, km: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows within the box of ``km`` round a point; degrees of longitude are taken as 111 km times the latitude's absolute value."""
    dy = km / 111
    dx = km / (111 * abs(lat)) if lat else dy
    return rows.where(F.col(lat_col).between(lat - dy, lat + dy) & F.col(lon_col).between(lon - dx, lon + dx))


def in_circle(rows: DataFrame, lat: float, lon: float, km: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows within ``km`` by great-circle distance."""
    a, b = F.radians(F.col(lat_col)), F.radians(F.lit(float(lat)))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.col(lon_col) - lon) / 2), 2)
    return rows.where(2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) <= km)


def near_join(left: DataFrame, right: DataFrame, width: float = 0.001) -> DataFrame:
    """Pairs of (id, lat, lon) less than ``width`` apart in both coordinates: cells of that width, each left row in its 3 x 3 cells, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), around.alias("o"), cell("lat").alias("_y"), cell("lon").alias("_x"))
    a = a.withColumn("y", F.col("_y") + F.col("o.i")).withColumn("x", F.col("_x") + F.col("o.j")).drop("o", "_y", "_x")
    b = right.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cell("lat").alias("y"), cell("lon").alias("x"))
    return a.join(b, ["y", "x"]).where((F.abs(F.col("lat_a") - F.col("lat_b")) < width) & (F.abs(F.col("lon_a") - F.col("lon_b")) < width)).drop("y", "x")


def nearest_entry(points: DataFrame, gazetteer: DataFrame, width: float) -> DataFrame:
    """(id, near) of the points (id, lat, lon): the name of the entry (name, lat, lon) with the least sum of distances in both coordinates among those less than ``width`` apart in each.

    Equal coordinates are joined once on both sides; of entries equally near the least name counts.
    """
    places = gazetteer.groupBy("lat", "lon").agg(F.min("name").alias("id"))
    spots = points.select("lat", "lon").distinct().withColumn("id", F.lit(0))
    dist = F.abs(F.col("lat_a") - F.col("lat_b")) + F.abs(F.col("lon_a") - F.col("lon_b"))
    best = near_join(spots, places, width).groupBy("lat_a", "lon_a").agg(F.min(F.struct(dist.alias("dist"), F.col("id_b").alias("near"))).alias("best"))
    return points.join(best, (points.lat == best.lat_a) & (points.lon == best.lon_a)).select("id", F.col("best.near").alias("near"))


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; the window's group limit prunes before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The 1-based page of the ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after_key(rows: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next ``size`` rows after a key."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(size)


def add_missing(base: DataFrame, extra: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``base`` with those rows of ``extra`` that share no single key with it or with an earlier row of ``extra``."""
    for k in keys:
        extra = extra.join(base.select(k).distinct(), k, "left_anti")
        extra = extra.withColumn("_n", F.row_number().over(W.partitionBy(k).orderBy(*order))).where("_n = 1").drop("_n")
    return base.unionByName(extra.select(*base.columns))


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` looked up by one key, else by another (one value per key in each table)."""
    a = first.select(first_key, F.col(value).alias("_a"))
    b = second.select(second_key, F.col(value).alias("_b"))
    return rows.join(a, first_key, "left").join(b, second_key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def numbered_names(spark: SparkSession, rows: DataFrame, folder: str, name: str, order: list[Column], out: str) -> DataFrame:
    """``rows`` with names made unique within their folder as ``out``.

    The first row of a name in ``order`` keeps it; the others get ``_1``, ``_2`` and so on before the suffix, where numbers whose names
    stand in the folder already are passed over. The free numbers come from one more ranking: a taken number t that is the
    i-th of its name stands before the (t - i + 1)-th row to be numbered, so a row's place among rows and taken numbers is its number.
    """
    placed = ranked(spark, rows, order, "_place", 0, [folder, name])
    stem, suffix = (F.regexp_extract(name, NAME, i) for i in (1, 2))
    used = placed.where("_place = 0").select(folder, stem.alias("_stem"), suffix.alias("_suffix"))
    base, number = (F.regexp_extract("_stem", r"(?s)^(.+)_([1-9][0-9]{0,16})$", i) for i in (1, 2))
    used = used.select(folder, F.concat(base, "_suffix").alias(name), number.try_cast("bigint").alias("_t")).where("_t is not null")
    again = placed.where("_place = 1").select(folder, name)
    same = lambda a, b: a[folder].eqNullSafe(b[folder]) & (a[name] == b[name])
    taken = used.join(again, same(used, again), "left_semi")
    taken = ranked(spark, taken, [F.col("_t")], "_i", 1, [folder, name]).select(folder, name, (F.col("_t") - F.col("_i") + 1).alias("_v"), F.lit(0).alias("_kind"))
    hit = taken.select(folder, name).distinct()
    later = placed.where("_place > 0")
    meets = later.join(hit, same(later, hit), "left_semi").select(*[later[c] for c in placed.columns], F.col("_place").alias("_v"), F.lit(1).alias("_kind"))
    moved = ranked(spark, meets.unionByName(taken, allowMissingColumns=True), [F.col("_v"), F.col("_kind")], "_number", 1, [folder, name]).where("_kind = 1")
    rest = placed.join(hit, same(placed, hit), "left_anti").unionByName(placed.where("_place = 0").join(hit, same(placed, hit), "left_semi"))
    both = rest.withColumn("_number", F.col("_place")).unionByName(moved.drop("_v", "_kind"))
    new = F.concat(stem, F.lit("_"), F.col("_number").cast("string"), suffix)
    return both.withColumn(out, F.when(F.col("_place") == 0, F.col(name)).otherwise(new)).drop("_place", "_number")
