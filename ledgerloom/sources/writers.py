"""Writers: JSON reports, quoted CSV, JSON-LD bundles, training sets, move plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.catalog import numbered_names


def json_report(rows: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def quoted_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def bundle(documents: DataFrame, key: str, text: str, per_file: int = 10_000) -> DataFrame:
    """JSON-LD texts in ``@graph`` bundles of at most ``per_file`` (a hash of the key picks the bundle); a bundle of one stays bare."""
    n = F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.lit(documents.count()) / per_file), F.lit(1)))
    g = documents.groupBy(n.cast("int").alias("bundle")).agg(F.sort_array(F.collect_list(F.struct(key, text))).alias("d"))
    body = F.array_join(F.transform("d", lambda x: x[text]), ",")
    return g.select("bundle", F.when(F.size("d") == 1, body).otherwise(F.concat(F.lit('{"@graph":['), body, F.lit("]}"))).alias("json"))


def training_set(parts: dict[str, DataFrame], path: str) -> None:
    """Features, vocabulary, labels, parts and statistics side by side."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def move_plan(files: DataFrame, folder: Column) -> DataFrame:
    """source, destination, status: where each file (path, filename) would go; names that meet in a folder are numbered."""
    rows = files.withColumn("folder", folder)
    rows = numbered_names(files.sparkSession, rows, "folder", "filename", [F.col("path")], "name")
    target = F.concat_ws("/", "folder", "name")
    return rows.select(F.col("path").alias("source"), target.alias("destination"), F.when(F.col("path") == target, "already_organized").otherwise("would_move").alias("status"))
