"""Queries p3 (groups of merged entities), p5 (surviving records) and p6 (terms of file names)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import group_pairs
from ledgerloom.llm.survivors import Field, discover
from ledgerloom.llm.terms import marked, term_frequencies, term_pairs
from ledgerloom.plans.tables import table


def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that events not rolled back join: kind, a, b. Source lists are read as all whole numbers in them, in whatever form they are written."""
    e = table(spark, d, "merge_events").where("not coalesce(is_rolled_back, false)")
    numbers = F.regexp_extract_all("source_entity_ids", F.lit(r"(?<![\d.])-?\d+(?:\.0+)?(?![\d.])"), F.lit(0))
    return e.select(
        F.nullif(F.trim(F.lower("target_entity_type")), F.lit("")).alias("kind"),
        F.col("target_entity_id").alias("b"),
        F.explode(F.transform(numbers, lambda x: F.regexp_replace(x, r"\.0+$", "").try_cast("bigint"))).alias("a"),
    ).where("kind is not null").select("kind", "a", "b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return group_pairs(spark, merge_pairs(spark, d)).select(F.col("kind").alias("entity_type"), F.col("id").alias("entity_id"), F.col("group").alias("group_id"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of each size there are."""
    sizes = p3_found(spark, d).groupBy("entity_type", "group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("entity_type", "size").agg(F.count(F.lit(1)).alias("groups"))


_PAIRS_SQL = r"""
WITH RECURSIVE pairs AS (
  SELECT nullif(trim(lower(target_entity_type)), '') AS kind, target_entity_id AS b,
         unnest(list_transform(regexp_extract_all(regexp_replace(source_entity_ids, '(\d)\.0+', '\1', 'g'), '-?\d+'), lambda x: x::BIGINT)) AS a
  FROM merge_events WHERE NOT coalesce(is_rolled_back, false)),
edges AS (SELECT DISTINCT kind, a, b FROM pairs WHERE a <> b AND kind IS NOT NULL UNION SELECT DISTINCT kind, b, a FROM pairs WHERE a <> b AND kind IS NOT NULL),
reach AS (SELECT kind, a AS id, a AS peer FROM edges UNION SELECT r.kind, r.id, e.b FROM reach r JOIN edges e ON e.kind = r.kind AND e.a = r.peer),
found AS (SELECT kind AS entity_type, id AS entity_id, min(peer) AS group_id FROM reach GROUP BY 1, 2)
"""


def _good(c: str) -> F.Column:
    return F.col(c).between(F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2026-06-30 23:59:59.999999").cast("timestamp_ntz"))


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


#: One @, something before it, a dotted host after it.
MAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def person_fields(fixed: bool) -> list[Field]:
    """The fields of a person. The rule of TESTDATA.md ranks addresses and times by ``last_seen`` and counts by size; with ``fixed`` its ties go to the smaller id, else to the votes."""
    email = F.regexp_replace("email", r"^[\s ]+|[\s ]+$", "")
    seen = F.when(_good("last_seen"), _micros("last_seen"))
    order = lambda c: (c, -F.col("id")) if fixed else c
    plain = lambda c: Field(c, F.nullif(F.trim(F.lower(c)), F.lit("")), F.trim(c) != "")
    ruled = [
        Field("email", email, email.rlike(MAIL), order(seen)),
        Field("last_seen", F.col("last_seen"), _good("last_seen"), order(seen)),
        Field("file_count", F.col("file_count"), F.col("file_count") >= 0, order(F.col("file_count"))),
    ]
    voted = [Field("mail_voted", F.lower(email), email.rlike(MAIL)), Field("count_voted", F.col("file_count"), F.col("file_count") >= 0)]
    return [*ruled, *([] if fixed else voted), plain("name"), plain("role")]


def person_sources() -> F.Column:
    """Where a row came from: the records of its ``source_ids``, or, if it names none, its role."""
    ids = F.filter(F.from_json("source_ids", "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(ids) > 0, F.transform(ids, lambda x: F.concat(F.lit("record "), x))).otherwise(F.array(F.concat(F.lit("role "), F.coalesce(F.trim(F.lower("role")), F.lit("")))))


def _survivors(spark: SparkSession, d: str, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The groups of two or more rows with the winning claims of each field, and the reliability of each source."""
    people = table(spark, d, "people")
    groups = people.where("canonical_id is not null").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    fields = person_fields(fixed)
    best, weights = discover(spark, people.join(groups, "canonical_id", "left_semi"), F.col("canonical_id"), F.col("id"), person_sources(), fields)
    wide = best.groupBy("grp").pivot("field", [f.name for f in fields]).agg(F.first("row_id").alias("id"), F.first("value").alias("value"), F.first("support").alias("support"))
    return groups.join(wide, groups.canonical_id == wide.grp, "left"), weights


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda f, name: F.coalesce(f"{f}_id", F.lit(0).cast("long")).alias(name)
    return _survivors(spark, d, fixed=True)[0].select("canonical_id", pick("email", "email_id"), pick("last_seen", "seen_id"), pick("file_count", "count_id"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One built record per group, with the support of each value; ``mail_voted`` and ``count_voted`` are what votes alone choose."""
    cols = [c for f in person_fields(False) for c in (F.col(f"{f.name}_value").alias(f.name), F.round(f"{f.name}_support", 3).alias(f"{f.name}_support"))]
    return _survivors(spark, d)[0].select("canonical_id", "rows", *cols)


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """The reliability of each source."""
    return _survivors(spark, d)[1].select(F.col("src").alias("source"), F.round("weight", 3).alias("weight"))


_GOOD_SQL = "last_seen BETWEEN TIMESTAMP '2021-01-01' AND TIMESTAMP '2026-06-30 23:59:59.999999'"
_P5_SQL = f"""
WITH g AS (SELECT canonical_id FROM people WHERE canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT *, CASE WHEN {_GOOD_SQL} THEN last_seen END AS seen,
      regexp_matches(regexp_replace(email, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'), '^[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+$') AS mail FROM people JOIN g USING (canonical_id)),
pick AS (SELECT canonical_id,
  first(id ORDER BY seen DESC NULLS LAST, id) FILTER (WHERE mail) AS e,
  first(id ORDER BY seen DESC, id) FILTER (WHERE seen IS NOT NULL) AS s,
  first(id ORDER BY file_count DESC, id) FILTER (WHERE file_count >= 0) AS c FROM p GROUP BY 1)
SELECT canonical_id, coalesce(e, 0)::BIGINT AS email_id, coalesce(s, 0)::BIGINT AS seen_id, coalesce(c, 0)::BIGINT AS count_id FROM pick
"""


def _filename_terms(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    named = table(spark, d, "files").select("id", "filename").where("id is not null and trim(filename) rlike '[^\\\\s\\u00a0]'")
    return term_frequencies(term_pairs(named.distinct(), F.col("filename"), F.col("id"))), named.select("id").distinct().count()


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """For each word its occurrences, its files and whether it is too rare or too common."""
    return marked(*_filename_terms(spark, d)).select("term", "occurrences", "records", F.array_join("marks", "+").alias("marks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return marked(*_filename_terms(spark, d)).select(F.explode("marks").alias("mark"), "term")


_TERMS_SQL = r"""
WITH named AS (SELECT DISTINCT id, filename FROM files WHERE id IS NOT NULL AND regexp_matches(filename, '[^\s\x{A0}]')),
words AS (SELECT id, unnest(regexp_extract_all(nfc_normalize(lower(filename)), '[\p{L}\p{N}]+')) AS term FROM named),
freq AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM words GROUP BY 1),
total AS (SELECT count(DISTINCT id) AS total FROM named),
marks AS (SELECT f.*, CASE WHEN records = 1 THEN 'rare' END AS rare, CASE WHEN records >= 0.05 * total THEN 'common' END AS common FROM freq f, total)
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_sizes, p5_found, p5_records, p5_sources, p6_found, p6_terms)}
SQL = {
    "p3_found": _PAIRS_SQL + "SELECT * FROM found",
    "p3_sizes": _PAIRS_SQL + "SELECT entity_type, size, count(*) AS groups FROM (SELECT entity_type, group_id, count(*) AS size FROM found GROUP BY 1, 2) GROUP BY 1, 2",
    "p5_found": _P5_SQL,
    "p6_terms": _TERMS_SQL + "SELECT term, occurrences, records, concat_ws('+', rare, common) AS marks FROM marks",
    "p6_found": _TERMS_SQL + "SELECT rare AS mark, term FROM marks WHERE rare IS NOT NULL UNION ALL SELECT common, term FROM marks WHERE common IS NOT NULL",
}
