"""Readers: directory listings, nested reports, usage logs, contacts, corrections, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import paths

RESULT = "source string, status string, reason string, destination string, schema string, extracted_text_length int, company_name string, people_names array<string>, category string, subcategory string, is_valid boolean"
REPORT = f"total_files int, organized int, already_organized int, skipped int, errors int, dry_run boolean, results array<struct<{RESULT.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' array', ':array')}>>"
USAGE = "map<string, struct<invocations:bigint, cost:double, seconds:double>>"


def listing(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, filename, size, modified of the files in a folder; contents are never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    f = r.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.select("path", paths.basename(F.col("path")).alias("filename"), "size", "modified")


def images(files: DataFrame, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "heic")) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*extensions))


def texts(spark: SparkSession, folder: str, glob: str = "*.txt", most: int | None = None) -> DataFrame:
    """path and text of text files; bytes that are no UTF-8 become replacement characters; ``most`` first characters if given, else the whole text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    text = F.decode("content", "UTF-8") if most is None else F.substring(F.decode("content", "UTF-8"), 1, most)
    return f.select("path", text.alias("text"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """The results of nested organization reports, one row each, with the name of their file."""
    return spark.read.schema(REPORT).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("report"), F.explode("results").alias("r")).select("report", "r.*")


def latest_report(files: DataFrame, priority: list[str]) -> DataFrame:
    """The newest file among those of the first pattern that has any."""
    rank: Column = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(priority))):
        rank = F.when(F.col("filename").rlike(p), i).otherwise(rank)
    return files.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("modified"), "path").limit(1).drop("rank")


def routed(files: DataFrame) -> DataFrame:
    """JSON files by what their name says they hold."""
    low = F.lower("filename")
    return files.where(low.endswith(".json")).withColumn("kind", F.when(low.contains("report") & low.contains("content"), "organization").when(low.contains("cost"), "cost").otherwise("other"))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """feature, invocations, cost, seconds of a report with one entry per feature."""
    return spark.read.schema(f"features {USAGE}").json(path, multiLine=True).select(F.explode("features").alias("feature", "u")).select("feature", "u.*")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """Properties of vCard files: path, card, property, value; folded lines are joined, parameters dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r?\n[ \t]", "").alias("text"))
    cards = raw.select("path", F.posexplode(F.filter(F.split("text", r"(?i)END:VCARD"), lambda x: x.rlike("(?i)BEGIN:VCARD"))).alias("card", "text"))
    lines = cards.select("path", "card", F.explode(F.split("text", r"\r?\n")).alias("line")).where(F.col("line").rlike("^[A-Za-z-]+[;:]"))
    key = F.upper(F.regexp_extract("line", "^([A-Za-z-]+)", 1))
    return lines.select("path", "card", key.alias("property"), F.regexp_extract("line", r"^[^:]+:(.*)$", 1).alias("value")).where("property not in ('BEGIN', 'VERSION')")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """hash, assigned, correct, patterns of a corrections file with one entry per content hash."""
    schema = "corrections map<string, struct<assigned_category:string, correct_category:string, filename_patterns:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("corrections").alias("hash", "c"))
    return rows.select("hash", F.col("c.assigned_category").alias("assigned"), F.col("c.correct_category").alias("correct"), F.col("c.filename_patterns").alias("patterns"))
