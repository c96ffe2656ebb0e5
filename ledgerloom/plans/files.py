"""Queries of sources and sinks: fixtures are written from the test tables into the work folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import paths, text
from ledgerloom.operators import catalog as op
from ledgerloom.operators import kv
from ledgerloom.plans.analytics import _KV, _NOW, _kv, _now
from ledgerloom.plans.catalog import CTE, files
from ledgerloom.plans.tables import table
from ledgerloom.session import Workspace
from ledgerloom.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(s, name: str) -> str:
    return f"{Workspace(s, 'fixture').root}/{name}"


def _one(rows: DataFrame, text_: F.Column, path: str) -> str:
    """A file of one line; only for fixtures of the tables of fixed size."""
    rows.agg(text_.alias("value")).coalesce(1).write.text(path)
    return path


def _levels(s, d) -> str:
    path = _folder(s, "levels")
    table(s, d, "categories").where("level is not null").select("name", "level").coalesce(1).write.partitionBy("level").option("compression", "none").text(path)
    return path


@query("SELECT DISTINCT level, true AS txt FROM categories WHERE level IS NOT NULL")
def src_dir_flat(s, d):
    """Listings of a folder and of what lies below it; a flat one of the top folder has no file of a table."""
    path = _levels(s, d)
    below, top = readers.listing(s, path, glob="*.txt"), readers.listing(s, path, recursive=False, glob="*.txt")
    return below.unionByName(top).select(F.regexp_extract("path", r"level=(-?\d+)", 1).cast("bigint").alias("level"), F.col("filename").endswith(".txt").alias("txt")).distinct()


@query("SELECT DISTINCT level, true AS kept FROM categories WHERE level > 1")
def src_dir_scan(s, d):
    """A listing without contents, less what a scan skips; sources are never read."""
    from ledgerloom.plans.scalars import KEEP_HIDDEN, SKIP_FILES

    rows = readers.listing(s, _levels(s, d))
    skip = paths.hidden_or_system(F.col("filename"), F.col("path"), KEEP_HIDDEN, [*SKIP_FILES, "_SUCCESS"], ["level=0", "level=1"])
    return rows.where(~skip).select(F.regexp_extract("path", r"level=(-?\d+)", 1).cast("bigint").alias("level"), F.lit(True).alias("kept")).distinct()


@query("SELECT item_id, length(text) AS chars, sha256(text) AS hash FROM eval_items WHERE text IS NOT NULL")
def src_text(s, d):
    """Whole text files: one for each test item, written and read back."""
    path = _folder(s, "texts")
    table(s, d, "eval_items").where("text is not null").select("text", "item_id").coalesce(1).write.partitionBy("item_id").option("compression", "none").text(path)
    t = F.regexp_replace("text", r"\n$", "")
    return readers.texts(s, path).select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.length(t).cast("bigint").alias("chars"), F.sha2(t, 256).alias("hash"))


@query(CTE + "SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS first FROM cur")
def src_batched_scan(s, d):
    """A scan in batches is a scan of partitions; each is one batch of a task."""
    parts = files(s, d).select("id").withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("k"), F.min("id").alias("first"))
    return parts.agg(F.sum("n").alias("rows"), F.sum("k").alias("ids"), F.min("first").alias("first"))


@query(CTE + "SELECT id, filename FROM cur WHERE regexp_extract(lower(filename), '\\.([^.]+)$', 1) IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp', 'heic')")
def src_image_scan(s, d):
    return readers.images(files(s, d).select("id", "filename"))


def _reports(s, d) -> str:
    result = F.struct(F.col("base_path").alias("source"), F.when(F.col("dry_run"), "would_organize").otherwise("organized").alias("status"), F.col("id").alias("reason"), F.array(F.lit("a"), F.lit("b")).alias("people_names"))
    j = F.to_json(F.struct("total_files", "dry_run", F.array(result).alias("results")))
    return _one(table(s, d, "organization_sessions"), F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(j)), ","), F.lit("]")), _folder(s, "reports"))


@query("SELECT base_path AS source, CASE WHEN dry_run THEN 'would_organize' ELSE 'organized' END AS status, id AS reason, 2 AS people FROM organization_sessions")
def src_report_json(s, d):
    """Nested reports, one row for each result."""
    return readers.report(s, _reports(s, d)).select("source", "status", "reason", F.size("people_names").alias("people"))


_LIST = CTE + ", list AS (SELECT id, lower(filename) AS filename, modified_at AS modified, id AS path FROM cur WHERE filename IS NOT NULL)\n"


def _listed(s, d) -> DataFrame:
    return files(s, d).where("filename is not null").select("id", F.lower("filename").alias("filename"), F.col("modified_at").alias("modified"), F.col("id").alias("path"))


@query(_LIST + "SELECT id, filename FROM (SELECT *, CASE WHEN regexp_matches(filename, 'blueprint') THEN 0 WHEN regexp_matches(filename, 'report') THEN 1 WHEN regexp_matches(filename, 'invoice') THEN 2 END AS rank FROM list) WHERE rank IS NOT NULL ORDER BY rank, modified DESC NULLS LAST, path LIMIT 1")
def src_latest_report(s, d):
    """The newest file of the first pattern that has any."""
    return readers.latest_report(_listed(s, d), ["blueprint", "report", "invoice"]).select("id", "filename")


@query(_LIST + "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(filename, 'report') AND contains(filename, 'content') THEN 'organization' WHEN contains(filename, 'cost') THEN 'cost' ELSE 'other' END AS kind FROM list WHERE ends_with(filename, '.json')) GROUP BY 1")
def src_report_routing(s, d):
    return readers.routed(_listed(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS feature, count(*) AS invocations, sum(user_id)::DOUBLE AS cost FROM events GROUP BY 1")
def src_cost_json(s, d):
    """A report with one entry for each feature."""
    n = table(s, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.struct(F.count(F.lit(1)).alias("invocations"), F.sum("user_id").cast("double").alias("cost"), F.lit(0.0).alias("seconds")).alias("v"))
    path = _one(n, F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("features"))), _folder(s, "usage"))
    return readers.usage(s, path).select("feature", "invocations", "cost")


@query("SELECT id::VARCHAR AS uid, name, nullif(domain, '') AS org FROM companies WHERE name IS NOT NULL AND NOT regexp_matches(name, '[\\r\\n]') AND trim(name) <> ''")
def src_vcard(s, d):
    """Contacts with folded lines, written and read back as one row for each card."""
    path = _folder(s, "cards")
    c = table(s, d, "companies").where(~F.col("name").rlike(r"[\r\n]") & (F.trim("name") != ""))
    org = F.when(F.col("domain") != "", F.concat(F.lit("ORG:"), "domain", F.lit("\n"))).otherwise("")
    c.select(F.concat(F.lit("BEGIN:VCARD\nVERSION:3.0\nUID:"), F.col("id").cast("string"), F.lit("\nFN;CHARSET=UTF-8:"), F.substring("name", 1, 2), F.lit("\n "), F.substring(F.col("name"), F.lit(3), F.length("name")), F.lit("\n"), org, F.lit("END:VCARD"))).write.text(path)
    p = readers.contacts(s, path)
    one = lambda name: F.max(F.when(F.col("property") == name, F.col("value")))
    return p.groupBy("path", "card").agg(one("UID").alias("uid"), one("FN").alias("name"), one("ORG").alias("org")).select("uid", "name", "org")


@query("SELECT md5(name) AS hash, 'x' AS assigned, name AS correct, 2 AS patterns FROM categories")
def src_feedback_json(s, d):
    """A file of corrections, one entry for each content hash."""
    entry = F.struct(F.md5("name").alias("k"), F.struct(F.lit("x").alias("assigned_category"), F.col("name").alias("correct_category"), F.array(F.lit("p"), F.lit("q")).alias("filename_patterns")).alias("v"))
    path = _one(table(s, d, "categories"), F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("corrections"))), _folder(s, "corrections"))
    return readers.corrections(s, path).select("hash", "assigned", "correct", F.size("patterns").alias("patterns"))


@query("SELECT id, name, level FROM categories")
def snk_json_report(s, d):
    path = _folder(s, "json")
    writers.json_report(table(s, d, "categories").select("id", "name", "level"), path)
    return s.read.schema("id bigint, name string, level bigint").json(path)


@query(CTE + "SELECT id, nullif(filename, '') AS filename, status FROM cur WHERE filename IS NOT NULL AND NOT regexp_matches(filename, '[\\r\\n]')")
def snk_csv(s, d):
    """All fields quoted, quotes doubled; read back they are the same, but that an empty text is null, which the format can't tell apart."""
    path = _folder(s, "csv")
    writers.quoted_csv(files(s, d).where(~F.col("filename").rlike(r"[\r\n]")).select("id", "filename", "status"), path)
    return s.read.csv(path, header=True, escape='"', schema="id string, filename string, status string", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("SELECT id FROM categories")
def snk_export_bulk(s, d):
    """Documents in bundles, taken apart again."""
    docs = table(s, d, "categories").select("id", F.to_json(F.struct("id")).alias("j"))
    b = writers.bundle(docs, "id", "j", per_file=50)
    each = F.coalesce(F.from_json(F.get_json_object("json", "$.@graph"), "array<struct<id:bigint>>"), F.array(F.from_json("json", "struct<id:bigint>")))
    return b.select(F.explode(each).alias("x")).select("x.id")


@query(CTE + "SELECT 'labels' AS part, count(DISTINCT schema_type) AS rows FROM cur UNION ALL SELECT 'features', count(*) FROM cur")
def snk_ml_export(s, d):
    """Parts of a training set side by side, counted after they are read back."""
    path, f = _folder(s, "training"), files(s, d)
    writers.training_set({"labels": f.where("schema_type is not null").select("schema_type").distinct(), "features": f.select("id", "file_size")}, path)
    one = lambda p: s.read.schema("id string").json(f"{path}/{p}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("part"), "rows")
    return one("labels").unionByName(one("features"))


@query(CTE + "SELECT original_path AS source, 'Sorted/' || schema_type AS folder, CASE WHEN 'Sorted/' || schema_type || '/' || filename = original_path THEN 'already_organized' ELSE 'would_move' END AS status, true AS unique_name FROM cur WHERE schema_type IS NOT NULL AND trim(filename) <> ''")
def snk_move_file(s, d):
    """A plan of moves in which no two files meet."""
    f = files(s, d).where("schema_type is not null and trim(filename) <> ''").select(F.col("original_path").alias("path"), "filename", "schema_type")
    plan = writers.move_plan(f, F.concat(F.lit("Sorted/"), "schema_type"))
    twice = plan.groupBy("destination").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(twice, "destination").select("source", F.regexp_extract("destination", "^(.*)/[^/]*$", 1).alias("folder"), "status", (F.col("n") == 1).alias("unique_name"))


@query("SELECT id, strptime(t, '%Y%m%d_%H%M%S') AS at FROM (SELECT DISTINCT id, strftime(started_at, '%Y%m%d_%H%M%S') AS t FROM organization_sessions WHERE started_at IS NOT NULL)")
def fn_report_ts(s, d):
    """The time that the name of a report tells."""
    t = table(s, d, "organization_sessions").where("started_at is not null")
    name = F.concat(F.lit("content_report_"), F.date_format("started_at", "yyyyMMdd_HHmmss"), F.lit(".json"))
    return t.select("id", text.report_time(name).cast("timestamp_ntz").alias("at")).distinct()


@query(_KV + "SELECT namespace, key FROM kv WHERE NOT (namespace = 'click' AND key IN ('user:1', 'user:2', 'user:77'))")
def kv_delete(s, d):
    return kv.delete(_kv(s, d), "click", ["user:1", "user:2", "user:77"]).select("namespace", "key")


@query(_KV + "SELECT namespace, count(*) AS keys FROM kv WHERE namespace <> 'click' GROUP BY 1")
def kv_flush(s, d):
    """A namespace emptied; flushing all leaves nothing."""
    t = _kv(s, d)
    return kv.flush(t, "click").unionByName(kv.flush(t)).groupBy("namespace").agg(F.count(F.lit(1)).alias("keys"))


@query(_KV + f"SELECT namespace, key, CASE WHEN namespace = 'click' AND key = 'user:3' THEN TIMESTAMP '{_NOW}' WHEN namespace = 'click' AND key = 'user:6' THEN NULL ELSE expires_at END AS expires_at FROM kv")
def kv_expire(s, d):
    """expire and persist."""
    t = kv.expire(_kv(s, d), "click", ["user:3"], _now())
    return kv.expire(t, "click", ["user:6"], None).select("namespace", "key", "expires_at")


@query(_KV + f"SELECT split_part(key, ':', 2) AS field, value FROM kv WHERE namespace = 'click' AND starts_with(key, 'user:') AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{_NOW}')")
def kv_hgetall(s, d):
    """The fields of a hash as rows (hget is a filter on them)."""
    return kv.fields(_kv(s, d), "click", "user", _now())


@query(_KV + "SELECT namespace, key, CASE WHEN namespace = 'click' AND key IN ('user:1', 'user:2') THEN 'set' ELSE value END AS value FROM kv WHERE NOT (namespace = 'click' AND key = 'user:3') UNION ALL SELECT 'click', 'user:new', 'set'")
def kv_hset(s, d):
    """Fields of a hash set, one of them new, and one deleted (hdel)."""
    new = s.createDataFrame([("1", "set"), ("2", "set"), ("new", "set")], "field string, value string")
    return kv.delete(kv.set_fields(_kv(s, d), "click", "user", new), "click", ["user:3"]).select("namespace", "key", "value")


@query("SELECT 'migration' AS namespace, 'json_file:levels' AS key, count(*) AS entries FROM categories")
def kv_store_json(s, d):
    """A whole JSON file as the value of one key."""
    path = _one(table(s, d, "categories"), F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("id"))), ","), F.lit("]")), _folder(s, "levels.json"))
    whole = s.read.text(path, wholetext=True).select(F.lit("migration").alias("namespace"), F.concat(F.lit("json_file:"), F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.json/", 1)).alias("key"), F.col("value"))
    return whole.select("namespace", "key", F.json_array_length("value").cast("bigint").alias("entries"))


@query("SELECT entity, name, max(id) AS id FROM (SELECT 'company' AS entity, name, id FROM companies WHERE name IS NOT NULL UNION ALL SELECT 'person', name, id FROM people WHERE name IS NOT NULL UNION ALL SELECT 'location', 'Unknown', NULL UNION ALL SELECT 'location', printf('(%.4f, %.4f)', c_custkey % 90 + 0.5, c_custkey % 180 + 0.25), NULL FROM customer UNION ALL SELECT e, 'New ' || n, NULL FROM (VALUES ('company'), ('person')) a(e), (VALUES ('one'), ('two')) b(n)) GROUP BY 1, 2")
def snk_migrate_entities(s, d):
    """snk_migrate_person, snk_migrate_location, snk_get_or_create of firms, persons and places: natural keys of reports become rows once; a place without a name is named by its point."""
    new = s.createDataFrame([("New one",), ("New two",), ("New one",), (None,)], "name string")
    base = lambda t: table(s, d, t).where("name is not null").groupBy("name").agg(F.max("id").alias("id"))
    c = F.col("c_custkey")
    point = F.format_string("(%.4f, %.4f)", (c % 90 + 0.5).cast("double"), (c % 180 + 0.25).cast("double"))
    spots = table(s, d, "customer").select(F.coalesce(F.lit(None).cast("string"), point, F.lit("Unknown")).alias("name")).unionByName(s.createDataFrame([("Unknown",)], "name string"))
    none = s.createDataFrame([], "name string, id bigint")
    parts = [("company", op.get_or_create(base("companies"), "name", new)), ("person", op.get_or_create(base("people"), "name", new)), ("location", op.get_or_create(none, "name", spots))]
    out = None
    for kind, df in parts:
        df = df.select(F.lit(kind).alias("entity"), "name", "id")
        out = df if out is None else out.unionByName(df)
    return out


@query(CTE + "SELECT id, CASE WHEN schema_type IS NULL THEN status WHEN status = 'pending' THEN 'organized' ELSE status END AS status, CASE WHEN schema_type IS NOT NULL AND status = 'pending' THEN 'Sorted/' || filename ELSE current_path END AS current_path, CASE WHEN schema_type IS NOT NULL AND status = 'pending' THEN 'by rule' END AS reason, CASE WHEN schema_type IS NOT NULL AND status = 'pending' THEN TIMESTAMP '2026-07-01' ELSE organized_at END AS organized_at FROM cur")
def snk_update_status_full(s, d):
    """Status, destination, reason and time of the files that an update names; destination and reason are taken even if null."""
    f = files(s, d).select("id", "status", "current_path", F.lit(None).cast("string").alias("reason"), "organized_at", "schema_type", "filename")
    change = f.where("schema_type is not null and status = 'pending'").select("id", F.lit("organized").alias("status"), F.concat(F.lit("Sorted/"), "filename").alias("current_path"), F.lit("by rule").alias("reason"), F.lit("2026-07-01 00:00:00").cast("timestamp_ntz").alias("organized_at"))
    return op.upsert(f.drop("schema_type", "filename"), change, ["id"])


@query("SELECT 'category' AS entity, id::VARCHAR AS id, name, 'urn:uuid:' || canonical_id AS iri FROM categories UNION ALL SELECT 'company', id::VARCHAR, name, 'urn:uuid:' || canonical_id FROM companies UNION ALL SELECT 'person', id::VARCHAR, name, 'urn:uuid:' || canonical_id FROM people UNION ALL SELECT 'session', id, base_path, 'urn:uuid:' || id FROM (SELECT DISTINCT id, base_path FROM organization_sessions) UNION ALL SELECT 'merge', id, merge_reason, NULL FROM (SELECT DISTINCT id, merge_reason FROM merge_events) UNION ALL SELECT 'file', id, filename, 'urn:sha256:' || id FROM (" + CTE + " SELECT * FROM cur)")
def prj_to_dict_all(s, d):
    """The public projection of each entity in one shape."""
    urn = lambda c: F.concat(F.lit("urn:uuid:"), c)
    shape = lambda df, kind, key, name, iri: df.select(F.lit(kind).alias("entity"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"), iri.alias("iri"))
    parts = [shape(table(s, d, t), k, "id", "name", urn(F.col("canonical_id"))) for t, k in (("categories", "category"), ("companies", "company"), ("people", "person"))]
    parts.append(shape(table(s, d, "organization_sessions").select("id", "base_path").distinct(), "session", "id", "base_path", urn(F.col("id"))))
    parts.append(shape(table(s, d, "merge_events").select("id", "merge_reason").distinct(), "merge", "id", "merge_reason", F.lit(None).cast("string")))
    parts.append(shape(files(s, d), "file", "id", "filename", F.concat(F.lit("urn:sha256:"), "id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
