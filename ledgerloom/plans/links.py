"""Queries of the general link problems: p1 (orphan references) and p2 (merge hierarchies)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.hierarchy import Hierarchy, hierarchy
from ledgerloom.operators.orphans import OrphanState, OrphanTracker
from ledgerloom.plans.tables import table

#: The tracker takes the history in batches of a year.
CUTS = [datetime(y, 1, 1) for y in range(2022, 2027)]
PARENTS = ["files", "categories", "organization_sessions"]


#: A key without case and outer white space, blank as null; of a file also without what the URN begins with.
_KEY = r"nullif(regexp_replace(lower({}), r'^[\s ]+|[\s ]+$', ''), '')"
_FILE_KEY = "nullif(regexp_replace(" + _KEY + ", '^urn:sha256:', ''), '')"


def references(links: DataFrame, files: DataFrame) -> DataFrame:
    """The three references: ref_field, parent, child, ref_key, key, at."""
    ref = lambda df, field, parent, child, value, key, at: df.selectExpr(
        f"'{field}' as ref_field", f"'{parent}' as parent", f"{child} as child", f"cast({value} as string) as ref_key", f"{key} as key", f"{at} as at"
    )
    return reduce(
        DataFrame.unionByName,
        [
            ref(links, "file_categories.file_id", "files", "file_id", "file_id", _FILE_KEY.format("file_id"), "created_at"),
            ref(links, "file_categories.category_id", "categories", "file_id", "category_id", "cast(category_id as string)", "created_at"),
            ref(files, "files.session_id", "organization_sessions", "id", "session_id", _KEY.format("session_id"), "db_created_at"),
        ],
    ).where("key is not null")


def _came(df: DataFrame, parent: str, key: str, at: str) -> DataFrame:
    return df.selectExpr(f"'{parent}' as parent", f"{key} as key", f"{at} as at")


def _batch(at: str) -> Column:
    """The number of a row's batch; the last one also takes rows without a time."""
    return F.expr("case " + " ".join(f"when {at} < timestamp_ntz'{c}' then {i}" for i, c in enumerate(CUTS)) + f" else {len(CUTS)} end")


def orphan_states(spark: SparkSession, d: str, deleted: DataFrame | None = None):
    """The tracker's state after each batch, with the batch's end. Each table is read once and written by batch; ``deleted``: parent, key, at."""
    tracker, n = OrphanTracker(spark, PARENTS, deletions=deleted is not None), len(CUTS) + 1
    links = tracker.work.split(table(spark, d, "file_categories").select("file_id", "category_id", "created_at"), _batch("created_at"), n, "links")
    files = tracker.work.split(table(spark, d, "files").select("id", "session_id", "db_created_at"), _batch("db_created_at"), n, "files")
    cats = _came(table(spark, d, "categories"), "categories", "cast(id as string)", "created_at")
    small = cats.unionByName(_came(table(spark, d, "organization_sessions"), "organization_sessions", _KEY.format("id"), "started_at"))
    for i, high in enumerate([*CUTS, None]):
        (l, l_rows), (f, f_rows) = links[i], files[i]
        came = _came(f, "files", _FILE_KEY.format("id"), "db_created_at").unionByName(small.where(_batch("at") == i))
        yield high, tracker.advance(references(l, f), came, None if deleted is None else deleted.where(_batch("at") == i), refs_rows=max(l_rows, f_rows))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    state: OrphanState = [s for _, s in orphan_states(spark, d)][-1]
    return state.resolved.unionByName(state.waiting.withColumn("resolved_at", F.lit(None).cast("timestamp_ntz")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", F.col("child").alias("file_id"), "ref_key").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field and month of the referring row."""
    return (
        _orphans(spark, d)
        .groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("orphans"), F.count("resolved_at").alias("came_later"), F.count_if(F.col("resolved_at").isNull()).alias("still_missing"))
    )


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """References that wait at the end of each batch."""
    snaps = [s.waiting.select("ref_field", F.lit(high.isoformat()[:10] if high else "end").alias("snapshot")) for high, s in orphan_states(spark, d)]
    return reduce(DataFrame.unionByName, snaps).groupBy("snapshot", "ref_field").agg(F.count(F.lit(1)).alias("waiting"))


def p1_reopened(spark: SparkSession, d: str) -> DataFrame:
    """References that wait at the end of each batch, by reason, where a category is deleted when it was merged away (at its ``updated_at``)."""
    gone = table(spark, d, "categories").where("merged_into_id is not null and updated_at is not null")
    gone = gone.select(F.lit("categories").alias("parent"), F.col("id").cast("string").alias("key"), F.col("updated_at").alias("at"))
    snaps = [s.waiting.select("ref_field", "reason", F.lit(high.isoformat()[:10] if high else "end").alias("snapshot")) for high, s in orphan_states(spark, d, gone)]
    return reduce(DataFrame.unionByName, snaps).groupBy("snapshot", "ref_field", "reason").agg(F.count(F.lit(1)).alias("waiting"))


_ORPHANS_SQL = """
WITH links AS (SELECT * FROM file_categories),
refs AS (
  SELECT 'file_categories.file_id' AS ref_field, 'files' AS parent, file_id AS child, file_id AS ref_key,
         nullif(regexp_replace(regexp_replace(lower(file_id), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), '^urn:sha256:', ''), '') AS key, created_at AS seen FROM links
  UNION SELECT 'file_categories.category_id', 'categories', file_id, category_id::VARCHAR, category_id::VARCHAR, created_at FROM links
  UNION SELECT 'files.session_id', 'organization_sessions', id, session_id,
         nullif(regexp_replace(lower(session_id), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), ''), db_created_at FROM files),
came AS (
  SELECT 'files' AS parent, nullif(regexp_replace(regexp_replace(lower(id), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), '^urn:sha256:', ''), '') AS key, db_created_at AS seen FROM files
  UNION ALL SELECT 'categories', id::VARCHAR, created_at FROM categories
  UNION ALL SELECT 'organization_sessions', nullif(regexp_replace(lower(id), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), ''), started_at FROM organization_sessions),
idx AS (SELECT parent, key, min(seen) AS since FROM came WHERE key IS NOT NULL GROUP BY 1, 2),
orphans AS (
  SELECT r.*, i.since AS resolved_at FROM refs r LEFT JOIN idx i USING (parent, key)
  WHERE r.key IS NOT NULL AND (i.key IS NULL OR r.seen < i.since))
"""

P1_SQL = {
    "p1_found": _ORPHANS_SQL + "SELECT DISTINCT ref_field, child AS file_id, ref_key FROM orphans",
    "p1_counts": _ORPHANS_SQL
    + "SELECT ref_field, strftime(seen, '%Y-%m') AS month, count(*) AS orphans, count(resolved_at) AS came_later, count(*) - count(resolved_at) AS still_missing FROM orphans GROUP BY 1, 2",
    "p1_snapshots": _ORPHANS_SQL
    + ", cuts AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{c:%Y-%m-%d}', TIMESTAMP '{c:%Y-%m-%d}')" for c in CUTS)
    + ", ('end', NULL)) t(snapshot, high))\n"
    + "SELECT snapshot, ref_field, count(*) AS waiting FROM orphans, cuts WHERE (high IS NULL AND resolved_at IS NULL) OR (seen < high AND (resolved_at IS NULL OR resolved_at >= high)) GROUP BY 1, 2",
}

_BATCH_SQL = "coalesce(least(greatest(year({}), 2021), 2026), 2026)"
P1_SQL["p1_reopened"] = (
    _ORPHANS_SQL
    + ", gone AS (SELECT 'categories' AS parent, id::VARCHAR AS key, updated_at AS at FROM categories WHERE merged_into_id IS NOT NULL AND updated_at IS NOT NULL), cuts AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{c:%Y-%m-%d}', TIMESTAMP '{c:%Y-%m-%d}')" for c in CUTS)
    + ", ('end', TIMESTAMP '9999-01-01')) t(snapshot, high)),\n"
    + "state AS (SELECT snapshot, ref_field, CASE WHEN i.key IS NULL OR i.since >= high THEN 'missing' WHEN g.at < high THEN "
    + f"CASE WHEN {_BATCH_SQL.format('r.seen')} < {_BATCH_SQL.format('i.since')} AND {_BATCH_SQL.format('i.since')} = {_BATCH_SQL.format('g.at')} THEN 'missing' ELSE 'deleted' END END AS reason\n"
    + "  FROM (SELECT * FROM refs WHERE key IS NOT NULL) r LEFT JOIN idx i USING (parent, key) LEFT JOIN gone g USING (parent, key), cuts WHERE coalesce(r.seen < high, snapshot = 'end'))\n"
    + "SELECT snapshot, ref_field, reason, count(*) AS waiting FROM state WHERE reason IS NOT NULL GROUP BY 1, 2, 3"
)


def merge_hierarchy(spark: SparkSession, d: str, paths: bool = False) -> Hierarchy:
    rows = lambda t, kind: table(spark, d, t).select(F.lit(kind).alias("kind"), "id", F.col("merged_into_id").alias("parent"))
    return hierarchy(spark, rows("categories", "category").unionByName(rows("people", "person")).unionByName(rows("companies", "company")), paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_hierarchy(spark, d).nodes.where("linked").select(F.col("kind").alias("entity_type"), F.col("id").alias("node_id"), F.col("root").alias("root_id"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """For each row its path (ids from itself to the end), depth, final row and whether it runs into a loop."""
    return merge_hierarchy(spark, d, paths=True).nodes.select(
        F.col("kind").alias("entity_type"),
        F.col("id").alias("node_id"),
        F.col("root").alias("root_id"),
        "depth",
        "in_loop",
        F.concat_ws("/", F.concat(F.array("id"), "path").cast("array<string>")).alias("path"),
    )


def p2_below(spark: SparkSession, d: str) -> DataFrame:
    """A row for each pair of a row and a row below it."""
    return merge_hierarchy(spark, d, paths=True).descendants().select(
        F.col("kind").alias("entity_type"), F.col("id").alias("node_id"), F.col("descendant").alias("below_id"), "distance"
    )


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    return merge_hierarchy(spark, d).loops.select(F.col("kind").alias("entity_type"), F.col("root").alias("loop_id"), F.col("id").alias("node_id"))


_LINKS_SQL = """
WITH RECURSIVE nodes AS (
  SELECT 'category' AS kind, id, min(merged_into_id) AS parent FROM categories WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'person', id, min(merged_into_id) FROM people WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'company', id, min(merged_into_id) FROM companies WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT n.kind, n.id, n.parent FROM nodes n JOIN nodes p ON p.kind = n.kind AND p.id = n.parent),
walk AS (
  SELECT kind, id, id AS at, [id] AS path, false AS closed FROM nodes
  UNION ALL
  SELECT w.kind, w.id, l.parent, CASE WHEN list_contains(w.path, l.parent) THEN w.path ELSE list_append(w.path, l.parent) END, list_contains(w.path, l.parent)
  FROM walk w JOIN links l ON l.kind = w.kind AND l.id = w.at WHERE NOT w.closed),
ends AS (
  SELECT w.kind, w.id, w.path, w.closed AS in_loop,
         CASE WHEN w.closed THEN list_min(list_slice(w.path, list_position(w.path, w.at), len(w.path))) ELSE w.at END AS root,
         CASE WHEN w.closed THEN list_slice(w.path, list_position(w.path, w.at), len(w.path)) END AS ring
  FROM walk w LEFT JOIN links l ON l.kind = w.kind AND l.id = w.at WHERE w.closed OR l.id IS NULL)
"""

P2_SQL = {
    "p2_found": _LINKS_SQL
    + "SELECT e.kind AS entity_type, e.id AS node_id, e.root AS root_id FROM ends e JOIN nodes n ON n.kind = e.kind AND n.id = e.id WHERE n.parent IS NOT NULL",
    "p2_paths": _LINKS_SQL
    + "SELECT kind AS entity_type, id AS node_id, root AS root_id, (len(path) - 1)::BIGINT AS depth, in_loop, array_to_string(path, '/') AS path FROM ends",
    "p2_below": _LINKS_SQL
    + "SELECT kind AS entity_type, u AS node_id, id AS below_id, (pos - 1)::BIGINT AS distance FROM (SELECT kind, id, unnest(path) AS u, generate_subscripts(path, 1) AS pos FROM ends) WHERE pos > 1",
    "p2_loops": _LINKS_SQL + "SELECT DISTINCT kind AS entity_type, root AS loop_id, unnest(ring) AS node_id FROM ends WHERE in_loop",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_snapshots, p1_reopened, p2_found, p2_paths, p2_below, p2_loops)}
SQL = P1_SQL | P2_SQL
