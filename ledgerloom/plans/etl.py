"""Queries of loading, updating and projecting: DML as joins, renaming plans, classes and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import ids, paths, text
from ledgerloom.operators import catalog as op
from ledgerloom.operators import feedback
from ledgerloom.plans.analytics import _LOG, _log, jsonld
from ledgerloom.plans.catalog import CTE, files, links
from ledgerloom.plans.scalars import _EXT_SQL, TOKENS_SQL, extension_class
from ledgerloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT name, max(id) AS id FROM (SELECT name, id FROM categories UNION ALL SELECT DISTINCT schema_type, NULL FROM files WHERE schema_type IS NOT NULL AND schema_type NOT IN (SELECT name FROM categories)) GROUP BY 1")
def snk_get_or_create(s, d):
    """New natural keys become rows; existing ones stay."""
    base = table(s, d, "categories").select("name", "id")
    return op.get_or_create(base, "name", table(s, d, "files").select(F.col("schema_type").alias("name")))


@query(CTE + "SELECT l.category_id, count(*) AS file_count, max(k.file_count) AS stored FROM link l JOIN categories k ON k.id = l.category_id GROUP BY 1")
def snk_link(s, d):
    """Links are idempotent, and the counters of the linked rows are derived rather than kept."""
    per = links(s, d).groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("file_count"))
    return per.join(table(s, d, "categories").select("id", F.col("file_count").alias("stored")), "id").select(F.col("id").alias("category_id"), "file_count", "stored")


@query("SELECT source, target, type, max(confidence) AS confidence FROM (SELECT target_entity_id AS target, unnest(regexp_extract_all(source_entity_ids, '\\d+'))::BIGINT AS source, lower(trim(target_entity_type)) AS type, confidence FROM merge_events) WHERE type IS NOT NULL GROUP BY 1, 2, 3")
def snk_edge_upsert(s, d):
    """One edge per (source, target, type)."""
    e = table(s, d, "merge_events").select(F.col("target_entity_id").alias("target"), F.explode(F.regexp_extract_all("source_entity_ids", F.lit(r"\d+"), F.lit(0)).cast("array<bigint>")).alias("source"), F.lower(F.trim("target_entity_type")).alias("type"), "confidence")
    return e.where("type is not null").groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"))


_SES = "nullif(lower(trim(session_id)), '')"


@query(CTE + f"SELECT {_SES} AS session, count(*) AS total, count(*) FILTER (WHERE status = 'organized') AS organized, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors FROM cur WHERE {_SES} IS NOT NULL GROUP BY 1")
def snk_session(s, d):
    """The closing statistics of sessions from their files."""
    f = files(s, d).withColumn("session", F.nullif(F.lower(F.trim("session_id")), F.lit(""))).where("session is not null")
    of = lambda v: F.count_if(F.col("status") == v)
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("total"), of("organized").alias("organized"), of("skipped").alias("skipped"), of("error").alias("errors"))


#: Statuses of reports and of the catalog.
STATUS = {"organized": "organized", "would_organize": "organized", "already_organized": "already_organized", "skipped": "skipped", "error": "error"}


@query(CTE + "SELECT id, CASE coalesce(status, '') WHEN 'organized' THEN 'organized' WHEN 'would_organize' THEN 'organized' WHEN 'already_organized' THEN 'already_organized' WHEN 'skipped' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'pending' END AS status, coalesce(current_path, original_path) AS destination FROM cur")
def snk_migrate_file(s, d):
    """Report rows to catalog rows: mapped statuses, destinations kept where there is none."""
    m = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return files(s, d).select("id", F.coalesce(F.try_element_at(m, F.coalesce("status", F.lit(""))), F.lit("pending")).alias("status"), F.coalesce("current_path", "original_path").alias("destination"))


@query(CTE + "SELECT id, CASE WHEN organized_at IS NULL AND status = 'organized' THEN TIMESTAMP '2026-07-01' ELSE organized_at END AS organized_at FROM cur")
def snk_update_status(s, d):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")
    return files(s, d).select("id", F.when(F.col("organized_at").isNull() & (F.col("status") == "organized"), now).otherwise(F.col("organized_at")).alias("organized_at"))


_U5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"SELECT id, coalesce(canonical_id, {_U5}) AS canonical_id FROM (SELECT id, canonical_id, sha1(unhex('c0e1a2b3456789abcdef012345678901') || encode(regexp_replace(lower(name), '^\\s+|\\s+$', '', 'g'))) AS h FROM companies)")
def snk_backfill(s, d):
    return table(s, d, "companies").select("id", F.coalesce("canonical_id", ids.uuid5(ids.NAMESPACES["company"], ids.normalized(F.col("name")))).alias("canonical_id"))


@query("SELECT id, name, NULL::VARCHAR AS color FROM categories")
def snk_schema_evolve(s, d):
    """A column that is missing is added as null; one that is there stays."""
    c = table(s, d, "categories")
    return (c if "color" in c.columns else c.withColumn("color", F.lit(None).cast("string"))).select("id", "name", "color")


@query(_LOG + "SELECT hash, category, id FROM log WHERE category = 'Dataset' AND hash IS NOT NULL")
def flt_corrections(s, d):
    return _log(s, d).where("category = 'Dataset' and hash is not null").select("hash", "category", "id")


@query(CTE + "SELECT c.id, c.filename, c.status, 'urn:sha256:' || c.id AS iri, (SELECT array_to_string(list_sort(list(k.name)), '|') FROM link l JOIN categories k ON k.id = l.category_id WHERE l.fid = c.id) AS categories FROM cur c")
def prj_to_dict(s, d):
    names = table(s, d, "categories").select(F.col("id").alias("category_id"), "name")
    per = links(s, d).join(names, "category_id").groupBy("fid").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("categories"))
    return files(s, d).join(per, F.col("id") == F.col("fid"), "left").select("id", "filename", "status", F.concat(F.lit("urn:sha256:"), "id").alias("iri"), "categories")


@query(CTE + "SELECT id, coalesce(filename, '') AS filename, coalesce(original_path, '') AS source, coalesce(current_path, '') AS destination, coalesce(status, 'unknown') AS status, coalesce(schema_type, 'uncategorized') AS category, coalesce(extracted_text_length, 0) AS text_length FROM cur")
def prj_metadata(s, d):
    has = lambda c, v, n: F.coalesce(F.col(c), F.lit(v)).alias(n)
    return files(s, d).select("id", has("filename", "", "filename"), has("original_path", "", "source"), has("current_path", "", "destination"), has("status", "unknown", "status"), has("schema_type", "uncategorized", "category"), has("extracted_text_length", 0, "text_length"))


@query(CTE + "SELECT l.fid AS id, split_part(k.full_path, '/', 1) AS category, CASE WHEN contains(k.full_path, '/') THEN split_part(k.full_path, '/', -1) END AS subcategory FROM link l JOIN categories k ON k.id = l.category_id")
def prj_label_record(s, d):
    parts = F.split("full_path", "/")
    k = table(s, d, "categories").select(F.col("id").alias("category_id"), parts[0].alias("category"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("subcategory"))
    return links(s, d).join(k, "category_id").select(F.col("fid").alias("id"), "category", "subcategory")


@query(
    CTE
    + ", base AS (SELECT original_path, filename FROM cur WHERE status = 'organized'), e AS (SELECT id, original_path IN (SELECT original_path FROM base WHERE original_path IS NOT NULL) AS p, filename IN (SELECT filename FROM base WHERE filename IS NOT NULL) AS f FROM cur WHERE status = 'pending' AND filename IS NOT NULL)"
    + " SELECT CASE WHEN p THEN 'by path' WHEN f THEN 'by filename' ELSE 'added' END AS outcome, count(*) AS n FROM e GROUP BY 1"
)
def agg_merge_stats(s, d):
    f = files(s, d)
    base, extra = f.where("status = 'organized'"), f.where("status = 'pending' and filename is not null")
    seen = lambda c: base.where(F.col(c).isNotNull()).select(c).distinct().withColumn(f"_{c}", F.lit(True))
    j = extra.select("original_path", "filename").join(seen("original_path"), "original_path", "left").join(seen("filename"), "filename", "left")
    return j.groupBy(F.when(F.col("_original_path"), "by path").when(F.col("_filename"), "by filename").otherwise("added").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(_LOG + ", t AS (SELECT pattern, sum(votes) AS total, max(votes) AS best FROM votes GROUP BY 1), r AS (SELECT t.pattern, min(v.category) AS category FROM t JOIN votes v ON v.pattern = t.pattern AND v.votes = best WHERE total >= 2 AND best / total >= 0.5 GROUP BY 1) SELECT category, array_to_string(list_sort(list(pattern)), ',') AS patterns FROM r GROUP BY 1")
def agg_keyword_rules(s, d):
    r = feedback.rules(feedback.pattern_votes(_log(s, d)), 2, 0.5)
    return r.groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("pattern")), ",").alias("patterns"))


@query(
    _LOG
    + ", t AS (SELECT pattern, sum(votes) AS total, max(votes) AS best FROM votes GROUP BY 1) SELECT count(*) AS patterns, count(*) FILTER (WHERE best / total >= 0.85) AS certain, sum(total)::BIGINT AS votes FROM t"
)
def agg_batch_feedback(s, d):
    t = feedback.pattern_votes(_log(s, d)).groupBy("pattern").agg(F.sum("votes").alias("total"), F.max("votes").alias("best"))
    return t.agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("best") / F.col("total") >= 0.85).alias("certain"), F.sum("total").alias("votes"))


#: Usual MIME types and languages of extensions.
MIME = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".txt": "text/plain", ".csv": "text/csv", ".json": "application/json", ".mp3": "audio/mpeg", ".mov": "video/quicktime", ".mp4": "video/mp4", ".zip": "application/zip", ".py": "text/x-python", ".html": "text/html"}
LANGUAGE = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".c": "C", ".cpp": "C++", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".html": "HTML", ".css": "CSS", ".sql": "SQL", ".sh": "Shell"}
_case = lambda m, other: "CASE lower(file_extension) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE '{other}' END"


@query(CTE + f"SELECT id, {_case(MIME, 'application/octet-stream')} AS mime, {_case(LANGUAGE, 'Unknown')} AS language FROM cur")
def fn_mime(s, d):
    """fn_mime and fn_language_of_ext: maps with a default."""
    at = lambda m, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.lower("file_extension")), F.lit(other))
    return files(s, d).select("id", at(MIME, "application/octet-stream").alias("mime"), at(LANGUAGE, "Unknown").alias("language"))


@query(
    CTE
    + f"SELECT id, 'Sorted/' || coalesce(schema_type, 'Other') || '/' || ({_EXT_SQL}) || CASE WHEN schema_type = 'ImageObject' AND created_at IS NOT NULL THEN '/' || strftime(created_at, '%Y/%m') ELSE '' END AS folder FROM cur"
)
def fn_dest_path(s, d):
    """Category, class and, for pictures, year and month as a folder."""
    dated = F.when((F.col("schema_type") == "ImageObject") & F.col("created_at").isNotNull(), F.date_format("created_at", "yyyy/MM"))
    return files(s, d).select("id", F.concat_ws("/", F.lit("Sorted"), F.coalesce("schema_type", F.lit("Other")), extension_class(F.col("file_extension")), dated).alias("folder"))


@query(
    CTE
    + r"""SELECT id, CASE WHEN regexp_matches(lower(filename), 'screenshot|bildschirmfoto|capture') THEN 'already_readable' WHEN created_at IS NULL THEN 'no_metadata' ELSE 'would_rename' END AS status,
  CASE WHEN NOT regexp_matches(lower(filename), 'screenshot|bildschirmfoto|capture') AND created_at IS NOT NULL THEN strftime(created_at, '%Y%m%d_%H%M%S') || regexp_extract(filename, '^.+(\.[^.]+)$', 1) END AS new_name FROM cur WHERE schema_type = 'ImageObject'"""
)
def fn_rename_plan(s, d):
    readable = F.lower("filename").rlike("screenshot|bildschirmfoto|capture")
    status = F.when(readable, "already_readable").when(F.col("created_at").isNull(), "no_metadata").otherwise("would_rename")
    name = F.concat(F.date_format("created_at", "yyyyMMdd_HHmmss"), paths.suffix(F.col("filename")))
    return files(s, d).where("schema_type = 'ImageObject'").select("id", status.alias("status"), F.when(~readable & F.col("created_at").isNotNull(), name).alias("new_name"))


_LABEL_SQL = r"string_split(replace(replace(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '_', ' '), '-', ' '), ' ')"
_NO_FIRM = ["invoice", "receipt", "bill", "statement"]


@query(CTE + f"SELECT id, array_to_string(list_transform({_LABEL_SQL}, lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, list_filter({_LABEL_SQL}, lambda w: w <> '' AND lower(w) NOT IN ('invoice', 'receipt', 'bill', 'statement') AND NOT regexp_matches(w, '^[0-9]+$'))[1] AS firm FROM cur")
def fn_org_from_filename(s, d):
    """The words of a name as a title, and the first that is neither a number nor says what the file is."""
    words = F.split(F.translate(paths.stem(F.col("filename")), "_-", "  "), " ")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    firm = F.try_element_at(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(_NO_FIRM) & ~w.rlike("^[0-9]+$")), F.lit(1))
    return files(s, d).select("id", title.alias("label"), firm.alias("firm"))


@query(CTE + f"SELECT id, CASE WHEN {'(' + _case(LANGUAGE, 'Unknown') + ')'} <> 'Unknown' THEN 'code' WHEN starts_with(mime_type, 'image/') AND image_width = image_height THEN 'icon' WHEN starts_with(mime_type, 'image/') THEN 'picture' WHEN starts_with(mime_type, 'audio/') OR starts_with(mime_type, 'video/') THEN 'media' ELSE 'document' END AS class FROM cur")
def cls_media(s, d):
    """cls_mime and cls_media: rules on MIME type, size and extension in order."""
    m = F.col("mime_type")
    rules = [
        (F.lower("file_extension").isin(*LANGUAGE), F.lit("code")),
        (m.startswith("image/") & (F.col("image_width") == F.col("image_height")), F.lit("icon")),
        (m.startswith("image/"), F.lit("picture")),
        (m.startswith("audio/") | m.startswith("video/"), F.lit("media")),
    ]
    return files(s, d).select("id", text.first_match(rules, F.lit("document")).alias("class"))


_GAME = ["sprite", "tile", "frame", "texture", "shader"]


@query(CTE + f", t AS (SELECT id, {TOKENS_SQL} AS t FROM cur WHERE filename IS NOT NULL) SELECT id, round(CASE WHEN len(t) = 0 THEN 0 ELSE least(1, least(len(list_filter(t, lambda w: w IN ('sprite', 'tile', 'frame', 'texture', 'shader'))) / len(t) * 1.5, 1) + CASE WHEN regexp_matches(t[-1], '^[0-9]+$') THEN 0.1 ELSE 0 END) END, 6) AS score FROM t")
def cls_game_score(s, d):
    """A share of telling words with a bonus for a number at the end, at most 1."""
    t = paths.tokens(F.col("filename"))
    hits = F.size(F.filter("t", lambda w: w.isin(*_GAME)))
    score = F.least(F.lit(1.0), F.least(hits / F.size("t") * 1.5, F.lit(1.0)) + F.when(F.element_at("t", -1).rlike("^[0-9]+$"), 0.1).otherwise(0.0))
    return files(s, d).where("filename is not null").select("id", t.alias("t")).select("id", F.round(F.when(F.size("t") == 0, F.lit(0.0)).otherwise(score), 6).alias("score"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i: {'v': -embedding[i + 1], 'i': i}))[:3], lambda x: x.i), ',') AS top FROM embeddings")
def cls_top_scores(s, d):
    """The places of the three highest scores of a vector."""
    scored = F.transform("embedding", lambda x, i: F.struct((-x).alias("v"), i.cast("bigint").alias("i")))
    return table(s, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(scored), 1, 3), lambda x: x["i"].cast("string")), ",").alias("top"))


@query(CTE + "SELECT schema_type AS type, count(*) AS documents, min(id) AS first FROM cur WHERE schema_type IS NOT NULL GROUP BY 1")
def reg_list(s, d):
    """reg_*: a registry of JSON-LD documents, the last of an id holding, counted by type."""
    f = files(s, d).where("schema_type is not null")
    r = f.select("id", jsonld(f).alias("json")).select("id", F.get_json_object("json", "$.@type").alias("type"))
    return r.groupBy("type").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"))


@query(CTE + "SELECT id, '<div itemscope itemtype=\"https://schema.org/' || coalesce(schema_type, 'DigitalDocument') || '\"><meta itemprop=\"name\" content=\"' || replace(replace(replace(replace(replace(filename, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '\"></div>' AS html FROM cur WHERE filename IS NOT NULL")
def fn_to_microdata(s, d):
    """fn_to_jsonld / script / microdata of flat documents as text columns."""
    html = F.concat(F.lit('<div itemscope itemtype="https://schema.org/'), F.coalesce("schema_type", F.lit("DigitalDocument")), F.lit('"><meta itemprop="name" content="'), text.html_escaped(F.col("filename")), F.lit('"></div>'))
    return files(s, d).where("filename is not null").select("id", html.alias("html"))


@query(CTE + "SELECT id, replace(url_encode(original_path), '%2F', '/') AS url FROM cur")
def fn_url_quote(s, d):
    return files(s, d).select("id", F.replace(ids.quoted(F.col("original_path")), F.lit("%2F"), F.lit("/")).alias("url"))


@query(CTE + "SELECT session, count(*) AS files, max(n) AS most FROM (SELECT nullif(lower(trim(session_id)), '') AS session, count(*) OVER (PARTITION BY content_hash) AS n FROM cur WHERE content_hash IS NOT NULL) WHERE session IS NOT NULL GROUP BY 1")
def agg_session_dupes(s, d):
    f = files(s, d).where("content_hash is not null").withColumn("session", F.nullif(F.lower(F.trim("session_id")), F.lit("")))
    n = f.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "content_hash").where("session is not null").groupBy("session").agg(F.count(F.lit(1)).alias("files"), F.max("n").alias("most"))
