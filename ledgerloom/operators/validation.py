"""Checks of documents as columns of messages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

MESSAGE = "array<struct<level:string,message:string,property:string>>"


def message(when: Column, level: str, text: str, prop: str) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"), F.lit(prop).alias("property")))


def validated(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """``rows`` with ``messages``, ``errors``, ``warnings`` and ``is_valid``; all checks in one projection."""
    out = rows.withColumn("messages", F.array_compact(F.array(*checks)).cast(MESSAGE) if checks else F.array().cast(MESSAGE))
    of = lambda level: F.size(F.filter("messages", lambda m: m["level"] == level))
    return out.withColumn("errors", of("error")).withColumn("warnings", of("warning")).withColumn("is_valid", F.col("errors") == 0)


def required(columns: list[str]) -> list[Column]:
    """Missing or empty."""
    return [message(F.col(c).isNull() | (F.col(c).cast("string") == ""), "error", "missing", c) for c in columns]


def formatted(patterns: dict[str, str]) -> list[Column]:
    return [message(~F.col(c).rlike(p), "error", "format", c) for c, p in patterns.items()]


def recommended(columns: list[str]) -> list[Column]:
    return [message(F.col(c).isNull(), "info", "recommended", c) for c in columns]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_valid")).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.round(F.try_divide(100 * F.count_if(F.col("is_valid")), F.count(F.lit(1))), 4).alias("valid_percent"),
    )


#: The kinds that are known, with what they must and should have; kinds of values; formats.
KINDS = {
    "Thing": ([], ["name", "description"]),
    "CreativeWork": (["name"], ["author", "datePublished"]),
    "DigitalDocument": (["name"], ["author", "encodingFormat"]),
    "Article": (["headline"], ["author", "datePublished", "image"]),
    "ImageObject": (["contentUrl"], ["name", "description"]),
    "VideoObject": (["name", "uploadDate"], ["description", "thumbnailUrl"]),
    "AudioObject": (["name"], ["contentUrl", "duration"]),
    "SoftwareSourceCode": (["name"], ["programmingLanguage", "codeRepository"]),
    "Dataset": (["name", "description"], ["creator", "distribution"]),
}
TEXTS = ["name", "description", "url", "contentUrl", "thumbnailUrl", "dateCreated", "dateModified", "datePublished", "uploadDate", "duration", "encodingFormat", "keywords"]
NUMBERS = ["width", "height"]
URLS = ["url", "contentUrl", "thumbnailUrl", "codeRepository", "sameAs"]
DATES = ["dateCreated", "dateModified", "datePublished", "uploadDate"]
URL = re.compile(r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$", re.I)
DATE = re.compile(r"^\d{4}-\d{2}-\d{2}(?:$|T\d{2}:\d{2}:\d{2})")
DURATION = re.compile(r"^P(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$")
#: What search engines want of articles, videos and pictures.
ARTICLES = {"Article", "NewsArticle", "BlogPosting"}
RICH = [(ARTICLES, "error", ["headline"]), (ARTICLES, "warning", ["image", "author", "datePublished"]), ({"VideoObject"}, "error", ["name", "description", "thumbnailUrl", "uploadDate"]), ({"ImageObject"}, "error", ["contentUrl"])]


def problems(doc: dict) -> Iterator[tuple[str, str, str | None]]:
    """(level, check, property) of what a document breaks, nodes within it included as far as they have errors."""
    kind = doc.get("@type")
    required, recommended = KINDS.get(kind, ((), ())) if isinstance(kind, str) else ((), ())
    text = lambda names: ((p, doc[p]) for p in names if isinstance(doc.get(p), str))
    if "@context" not in doc:
        yield "error", "context", "@context"
    if "@type" not in doc:
        yield "error", "type", "@type"
    elif isinstance(kind, str) and kind in KINDS:
        yield "success", "type", None
    else:
        yield "warning", "unknown type", "@type"
    for p in required:
        if not doc.get(p):
            yield "error", "empty" if p in doc else "missing", p
    for names, of in ((TEXTS, str), (NUMBERS, int)):
        yield from (("error", "value type", p) for p in names if p in doc and not isinstance(doc[p], (of, dict, list)))
    yield from (("error", "url", p) for p, v in text(URLS) if not URL.match(v))
    yield from (("warning", "date", p) for p, v in text(DATES) if not DATE.match(v))
    yield from (("warning", "duration", p) for p, v in text(["duration"]) if not DURATION.match(v))
    for p, v in doc.items():
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, dict) and "@type" in x and any(level == "error" for level, _, _ in problems(x)):
                yield "warning", "nested", p
    if lacking := [p for p in recommended if p not in doc]:
        yield "info", "recommended", ", ".join(lacking)
    for kinds, level, names in RICH:
        if isinstance(kind, str) and kind in kinds:
            yield from ((level, "rich results", p) for p in names if p not in doc)


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("level", "message", "property")])))
def document_messages(texts: pd.Series) -> pd.Series:
    """What the JSON text of a document breaks; a text that is no JSON object has one error. Nodes may be nested to any depth, which columns can't follow."""

    def one(t):
        try:
            doc = json.loads(t)
        except (TypeError, ValueError):
            doc = None
        found = problems(doc) if isinstance(doc, dict) else [("error", "no object", None)]
        return [{"level": a, "message": b, "property": c} for a, b, c in found]

    return texts.map(one)


def report(rows: DataFrame, doc: Column) -> DataFrame:
    """``rows`` with ``messages`` of their documents and the numbers of them by level, ``is_valid`` if there is no error."""
    out = rows.withColumn("messages", document_messages(doc))
    of = lambda level: F.size(F.filter("messages", lambda m: m["level"] == level))
    return out.withColumn("errors", of("error")).withColumn("warnings", of("warning")).withColumn("infos", of("info")).withColumn("is_valid", F.col("errors") == 0)
