"""Queries of the file catalog: filters, joins, aggregates, windows and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions import ids
from ledgerloom.operators import catalog as op
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


def files(s: SparkSession, d: str) -> DataFrame:
    """The current row of each file. Only the columns that a query uses are read; filters on the id reach the scan."""
    return op.latest(table(s, d, "files"), ["id"], ["db_updated_at", "status", "modified_at", "file_size"], total=False).withColumn("status", F.lower("status"))


def links(s: SparkSession, d: str) -> DataFrame:
    """Each file and category once: fid, category_id, confidence."""
    fid = F.regexp_replace(ids.normalized(F.col("file_id")), "^urn:sha256:", "")
    return table(s, d, "file_categories").where("file_id is not null and category_id is not null").groupBy(fid.alias("fid"), "category_id").agg(F.max("confidence").alias("confidence"))


CTE = r"""
WITH cur AS (SELECT * REPLACE (lower(status) AS status) FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY db_updated_at DESC NULLS LAST, status DESC NULLS LAST) = 1),
link AS (SELECT regexp_replace(regexp_replace(lower(file_id), '^\s+|\s+$', '', 'g'), '^urn:sha256:', '') AS fid, category_id, max(confidence) AS confidence
         FROM file_categories WHERE file_id IS NOT NULL AND category_id IS NOT NULL GROUP BY 1, 2)
"""


@query("SELECT id, filename, status FROM (" + CTE + " SELECT * FROM cur) WHERE id = (SELECT min(id) FROM files)")
def flt_file_point(s, d):
    """A lookup by key: the filter goes through to the scan."""
    key = table(s, d, "files").agg(F.min("id")).first()[0]
    return files(s, d).where(F.col("id") == key).select("id", "filename", "status")


@query(CTE + "SELECT id, filename, status, organized_at FROM cur WHERE status = 'organized' AND lower(file_extension) = '.pdf' ORDER BY organized_at DESC NULLS LAST, id OFFSET 20 LIMIT 100")
def flt_files(s, d):
    rows = files(s, d).where((F.col("status") == "organized") & (F.lower("file_extension") == ".pdf"))
    return op.page(rows, [F.col("organized_at").desc_nulls_last(), F.col("id")], 1, 120).offset(20).limit(100).select("id", "filename", "status", "organized_at")


@query(
    CTE
    + "SELECT c.id, c.filename, c.organized_at FROM cur c JOIN link l ON l.fid = c.id JOIN categories k ON k.id = l.category_id WHERE k.name = 'Paperwork' AND c.status = 'organized' ORDER BY organized_at DESC NULLS LAST, c.id LIMIT 100"
)
def flt_files_by_category(s, d):
    named = table(s, d, "categories").where("name = 'Paperwork'").select(F.col("id").alias("category_id"))
    rows = files(s, d).where("status = 'organized'").join(links(s, d).join(named, "category_id"), F.col("id") == F.col("fid"))
    return rows.orderBy(F.col("organized_at").desc_nulls_last(), "id").limit(100).select("id", "filename", "organized_at")


@query("SELECT doc_id, source, text FROM documents WHERE text ILIKE '%tax form%' OR source ILIKE '%tax form%'")
def flt_search_text(s, d):
    return op.search(table(s, d, "documents").select("doc_id", "source", "text"), "tax form", ["text", "source"])


@query(CTE + "SELECT id, filename FROM cur WHERE filename ILIKE '%invoice%'")
def flt_search_filename(s, d):
    return op.search(files(s, d).select("id", "filename"), "invoice", ["filename"])


def places(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(s, d, "customer").select(c.alias("id"), F.col("c_name").alias("name"), ((c % 180) - 90 + (c % 7) / 1000).alias("lat"), ((c % 360) - 180 + (c % 5) / 2000).alias("lon"))


_PLACES = "WITH places AS (SELECT c_custkey AS id, c_name AS name, (c_custkey % 180) - 90 + (c_custkey % 7) / 1000 AS lat, (c_custkey % 360) - 180 + (c_custkey % 5) / 2000 AS lon FROM customer)\n"


@query(_PLACES + "SELECT id, name FROM places WHERE lat BETWEEN 40 - 500 / 111.0 AND 40 + 500 / 111.0 AND lon BETWEEN -50 - 500 / (111.0 * 40) AND -50 + 500 / (111.0 * 40)")
def flt_search_geo(s, d):
    return op.in_box(places(s, d), 40.0, -50.0, 500).select("id", "name")


@query(_PLACES + "SELECT id, name FROM places WHERE 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 40) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(lon + 50) / 2), 2))) <= 800")
def flt_search_circle(s, d):
    return op.in_circle(places(s, d), 40.0, -50.0, 800).select("id", "name")


@query(_PLACES + "SELECT a.id AS id_a, b.id AS id_b FROM places a JOIN places b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001 AND abs(a.lon - b.lon) < 0.001")
def jn_near_location(s, d):
    p = places(s, d).select("id", "lat", "lon")
    return op.near_join(p, p).where("id_a < id_b").select("id_a", "id_b")


@query("SELECT event_id, ts, event_type, value FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def flt_cost_range(s, d):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(s, d, "events").where((F.col("event_type") == "click") & F.col("ts").between(day("2024-01-05"), day("2024-01-09"))).select("event_id", "ts", "event_type", "value")


@query(CTE + "SELECT id, filename, original_path FROM cur WHERE status = 'organized' AND schema_type = 'ImageObject' AND contains(lower(concat_ws(' ', filename, original_path, current_path)), 'desk')")
def flt_viewer(s, d):
    text = F.lower(F.concat_ws(" ", "filename", "original_path", "current_path"))
    return files(s, d).where((F.col("status") == "organized") & (F.col("schema_type") == "ImageObject") & text.contains("desk")).select("id", "filename", "original_path")


@query(
    CTE
    + "SELECT c.id AS file_id, k.id AS category_id, k.name AS category, l.confidence FROM cur c JOIN link l ON l.fid = c.id JOIN categories k ON k.id = l.category_id"
)
def jn_file_category(s, d):
    cats = table(s, d, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return files(s, d).select(F.col("id").alias("file_id")).join(links(s, d), F.col("file_id") == F.col("fid")).join(cats, "category_id").select("file_id", "category_id", "category", "confidence")


@query(
    CTE
    + "SELECT c.id AS file_id, count(k.id) AS n, coalesce(array_to_string(list_sort(list(k.name) FILTER (WHERE k.id IS NOT NULL)), '|'), '') AS names FROM cur c LEFT JOIN link l ON l.fid = c.id LEFT JOIN categories k ON k.id = l.category_id GROUP BY 1"
)
def jn_eager_outer(s, d):
    """Files with the names of their categories; links are aggregated before the outer join, so no file's row is multiplied."""
    cats = table(s, d, "categories").select(F.col("id").alias("category_id"), "name")
    per = links(s, d).join(cats, "category_id").groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))
    return files(s, d).select(F.col("id").alias("file_id")).join(per, F.col("file_id") == F.col("fid"), "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.lit("")).alias("names"))


@query(CTE + "SELECT k.id, k.name, count(l.fid) AS files FROM categories k LEFT JOIN link l ON l.category_id = k.id GROUP BY 1, 2")
def jn_category_left(s, d):
    per = links(s, d).groupBy("category_id").agg(F.count("fid").alias("files"))
    return table(s, d, "categories").join(per, F.col("id") == F.col("category_id"), "left").select("id", "name", F.coalesce("files", F.lit(0)).alias("files"))


@query(CTE + "SELECT k.name, count(*) AS files FROM categories k JOIN link l ON l.category_id = k.id GROUP BY 1")
def agg_category_breakdown(s, d):
    per = links(s, d).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    return table(s, d, "categories").select(F.col("id").alias("category_id"), "name").join(per, "category_id").groupBy("name").agg(F.sum("n").alias("files"))


@query(CTE + "SELECT k.id, k.name, count(*) AS files, round(avg(l.confidence), 6) AS confidence FROM categories k JOIN link l ON l.category_id = k.id GROUP BY 1, 2")
def jn_category_counts(s, d):
    """Categories that have files, by id; links are aggregated before the join with the names."""
    per = links(s, d).groupBy("category_id").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return table(s, d, "categories").join(per, F.col("id") == F.col("category_id")).select("id", "name", "files", "confidence")


@query(CTE + "SELECT k.name, count(l.fid) AS files FROM categories k LEFT JOIN link l ON l.category_id = k.id GROUP BY 1 ORDER BY files DESC, name LIMIT 5")
def agg_top5_categories(s, d):
    return jn_category_left(s, d).groupBy("name").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "name").limit(5)


@query("SELECT c.id, c.name, p.name AS parent, p.level AS parent_level FROM categories c JOIN categories p ON p.id = c.parent_id")
def jn_self_parent(s, d):
    c = table(s, d, "categories")
    return c.alias("c").join(c.alias("p"), F.col("c.parent_id") == F.col("p.id")).select("c.id", "c.name", F.col("p.name").alias("parent"), F.col("p.level").alias("parent_level"))


@query(CTE + "SELECT session_id, count(*) AS files FROM cur WHERE session_id <> '08585d17-b395-45c0-9e8f-c4d5ea4cfea8' GROUP BY 1")
def jn_theta_not_equal(s, d):
    """Rows without a session drop out, as under SQL's three-valued logic."""
    return files(s, d).where(F.col("session_id") != "08585d17-b395-45c0-9e8f-c4d5ea4cfea8").groupBy("session_id").agg(F.count(F.lit(1)).alias("files"))


@query(
    CTE
    + ", base AS (SELECT original_path, filename FROM cur WHERE status = 'organized'), extra AS (SELECT original_path, filename FROM cur WHERE status = 'pending' AND filename IS NOT NULL),"
    + " a AS (SELECT * FROM extra WHERE original_path NOT IN (SELECT original_path FROM base WHERE original_path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY original_path ORDER BY original_path) = 1),"
    + " b AS (SELECT * FROM a WHERE filename NOT IN (SELECT filename FROM base WHERE filename IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY filename ORDER BY original_path) = 1)"
    + " SELECT * FROM base UNION ALL SELECT * FROM b"
)
def jn_semi_anti_merge(s, d):
    rows = files(s, d).select("status", "original_path", "filename")
    base, extra = rows.where("status = 'organized'").drop("status"), rows.where("status = 'pending' and filename is not null").drop("status")
    return op.add_missing(base, extra, ["original_path", "filename"], [F.col("original_path")])


@query(
    CTE
    + ", p AS (SELECT original_path, min(schema_type) AS v FROM cur WHERE status = 'organized' GROUP BY 1), f AS (SELECT filename, min(schema_type) AS v FROM cur WHERE status <> 'organized' GROUP BY 1)"
    + " SELECT c.id, coalesce(p.v, f.v) AS label FROM cur c LEFT JOIN p USING (original_path) LEFT JOIN f USING (filename)"
)
def jn_precedence(s, d):
    rows = files(s, d)
    by = lambda key, when: rows.where(when).groupBy(key).agg(F.min("schema_type").alias("label"))
    return op.with_fallback(rows.select("id", "original_path", "filename"), by("original_path", "status = 'organized'"), by("filename", "status <> 'organized'"), "original_path", "filename", "label").select("id", "label")


@query(
    CTE
    + "SELECT count(*) AS files, count(*) FILTER (WHERE status = 'organized') AS organized, (SELECT count(*) FROM categories) AS categories, (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM people) AS people, (SELECT count(*) FROM link) AS links, (SELECT count(DISTINCT id) FROM organization_sessions) AS sessions FROM cur"
)
def agg_scalar_counts(s, d):
    """Independent counts, each one row, side by side through one union."""
    one = lambda name, df, c=None: df.agg((c if c is not None else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("what"), "n")
    f = files(s, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "organized").alias("organized")).select(F.explode(F.create_map(F.lit("files"), "files", F.lit("organized"), "organized")).alias("what", "n"))
    parts = f.unionByName(one("links", links(s, d))).unionByName(one("sessions", table(s, d, "organization_sessions"), F.countDistinct("id")))
    for t in ("categories", "companies", "people"):
        parts = parts.unionByName(one(t, table(s, d, t)))
    names = ["files", "organized", "categories", "companies", "people", "links", "sessions"]
    return parts.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])


@query(CTE + "SELECT coalesce(nullif(lower(file_extension), ''), 'none') AS ext, count(*) AS files FROM cur GROUP BY 1 ORDER BY files DESC, ext LIMIT 20")
def agg_extension_top20(s, d):
    ext = F.coalesce(F.nullif(F.lower("file_extension"), F.lit("")), F.lit("none")).alias("ext")
    return files(s, d).groupBy(ext).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(20)


@query(CTE + "SELECT content_hash, count(*) AS files, min(id) AS first_id, sum(file_size)::BIGINT AS bytes FROM cur WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def agg_dupes(s, d):
    """Groups of files of one content; a group's members are listed by dupes_members, not gathered."""
    return files(s, d).where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first_id"), F.sum("file_size").alias("bytes")).where("files > 1")


@query(CTE + ", g AS (SELECT content_hash FROM cur WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT content_hash, id FROM cur JOIN g USING (content_hash)")
def agg_dupes_members(s, d):
    f = files(s, d).select("content_hash", "id")
    return f.join(f.where("content_hash is not null").groupBy("content_hash").count().where("count > 1").select("content_hash"), "content_hash", "left_semi")


_SESSION = "nullif(lower(trim(session_id)), '')"


def _sessions(s, d) -> DataFrame:
    return files(s, d).withColumn("session", F.nullif(F.lower(F.trim("session_id")), F.lit(""))).where("session is not null")


@query(
    CTE
    + f", n AS (SELECT {_SESSION} AS session, category_id, count(*) AS files, avg(confidence) AS confidence FROM cur c JOIN link l ON l.fid = c.id WHERE {_SESSION} IS NOT NULL GROUP BY 1, 2)"
    + " SELECT session, k.name, files, round(confidence, 4) AS confidence, row_number() OVER (PARTITION BY session ORDER BY files DESC, k.name) AS rank FROM n JOIN categories k ON k.id = category_id QUALIFY rank <= 10"
)
def agg_session_categories(s, d):
    """The ten largest categories of every session, with their mean confidence."""
    cats = table(s, d, "categories").select(F.col("id").alias("category_id"), "name")
    n = _sessions(s, d).select("id", "session").join(links(s, d), F.col("id") == F.col("fid")).groupBy("session", "category_id").agg(F.count(F.lit(1)).alias("files"), F.avg("confidence").alias("confidence"))
    return op.top_per_group(n.join(cats, "category_id"), ["session"], [F.desc("files"), F.col("name")], 10).select("session", "name", "files", F.round("confidence", 4).alias("confidence"), "rank")


@query(
    CTE
    + f", n AS (SELECT {_SESSION} AS session, lower(file_extension) AS ext, count(*) AS files FROM cur WHERE {_SESSION} IS NOT NULL GROUP BY 1, 2) SELECT session, ext, files, row_number() OVER (PARTITION BY session ORDER BY files DESC, ext NULLS FIRST) AS rank FROM n QUALIFY rank <= 10"
)
def agg_session_ext(s, d):
    n = _sessions(s, d).groupBy("session", F.lower("file_extension").alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    return op.top_per_group(n, ["session"], [F.desc("files"), F.col("ext")], 10)


@query(CTE + "SELECT coalesce(schema_type, 'none') AS kind, id, file_size, row_number() OVER (PARTITION BY coalesce(schema_type, 'none') ORDER BY file_size DESC NULLS LAST, id) AS rank FROM cur QUALIFY rank <= 10")
def win_topk_group(s, d):
    """The ten largest files of each type: the window's group limit drops the rest before the shuffle."""
    rows = files(s, d).select(F.coalesce("schema_type", F.lit("none")).alias("kind"), "id", "file_size")
    return op.top_per_group(rows, ["kind"], [F.col("file_size").desc_nulls_last(), F.col("id")], 10)


@query(CTE + f"SELECT {_SESSION} AS session, schema_type, count(*) AS files FROM cur WHERE schema_type IS NOT NULL AND {_SESSION} IS NOT NULL GROUP BY 1, 2")
def agg_session_schema(s, d):
    return _sessions(s, d).where("schema_type is not null").groupBy("session", "schema_type").agg(F.count(F.lit(1)).alias("files"))


@query(CTE + f"SELECT count(DISTINCT {_SESSION}) AS sessions, count(*) AS files, count(*) FILTER (WHERE status = 'organized') AS organized, round(avg(processing_time_sec), 6) AS mean_time FROM cur WHERE {_SESSION} IS NOT NULL")
def agg_cumulative(s, d):
    return _sessions(s, d).agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "organized").alias("organized"), F.round(F.avg("processing_time_sec"), 6).alias("mean_time"))


_RUNS = "WITH runs AS (SELECT * FROM organization_sessions WHERE total_files > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY started_at, total_files) = 1)\n"


def _runs(s, d) -> DataFrame:
    """Sessions with files, each once."""
    w = W.partitionBy("id").orderBy("started_at", "total_files")
    return table(s, d, "organization_sessions").where("total_files > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@query(_RUNS + "SELECT id, total_files, round(100.0 * organized_count / total_files, 1) AS success_rate FROM runs")
def agg_success_rate(s, d):
    return _runs(s, d).select("id", "total_files", F.round(100.0 * F.col("organized_count") / F.col("total_files"), 1).alias("success_rate"))


@query(
    _RUNS
    + "SELECT dry_run, count(*) AS runs, sum(total_files)::BIGINT AS files, round(avg(100.0 * organized_count / total_files), 4) AS mean_success, round(sum(total_cost::DECIMAL(18,6)), 6)::DOUBLE AS cost, round(sum(total_processing_time_sec::DECIMAL(18,6)), 4)::DOUBLE AS seconds FROM runs GROUP BY 1"
)
def agg_aggregate_stats(s, d):
    exact = lambda c, n: F.round(F.sum(F.col(c).cast("decimal(18,6)")), n).cast("double")
    return _runs(s, d).groupBy("dry_run").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_files").alias("files"), F.round(F.avg(100.0 * F.col("organized_count") / F.col("total_files")), 4).alias("mean_success"),
        exact("total_cost", 6).alias("cost"), exact("total_processing_time_sec", 4).alias("seconds"),
    )


@query(
    _RUNS
    + ", r AS (SELECT *, round(100.0 * organized_count / total_files, 1) AS rate FROM runs), w AS (SELECT *, row_number() OVER o AS n, lag(total_files) OVER o AS f, lag(organized_count) OVER o AS g, lag(rate) OVER o AS h, lag(total_cost) OVER o AS c0, lag(total_processing_time_sec) OVER o AS t0 FROM r WINDOW o AS (ORDER BY started_at, id))"
    + " SELECT id, n = 1 AS is_first, CASE WHEN n = 1 THEN total_files ELSE total_files - f END AS files_delta, CASE WHEN n = 1 THEN organized_count ELSE organized_count - g END AS organized_delta, round(rate - h, 1) AS rate_delta, CASE WHEN n > 1 THEN round(coalesce(total_cost, 0)::DECIMAL(18,6) - coalesce(c0, 0)::DECIMAL(18,6), 4)::DOUBLE END AS cost_delta, CASE WHEN n > 1 THEN round(coalesce(total_processing_time_sec, 0)::DECIMAL(18,6) - coalesce(t0, 0)::DECIMAL(18,6), 2)::DOUBLE END AS time_delta FROM w"
)
def win_session_lag(s, d):
    """Changes against the session before. There is one row per session here, so one ordered partition holds them."""
    w = W.orderBy("started_at", "id")
    r = _runs(s, d).withColumn("rate", F.round(100.0 * F.col("organized_count") / F.col("total_files"), 1)).withColumn("first", F.row_number().over(w) == 1)
    delta = lambda c: F.when(F.col("first"), F.col(c)).otherwise(F.col(c) - F.lag(c).over(w))
    exact = lambda c: F.coalesce(c, F.lit(0.0)).cast("decimal(18,6)")
    since = lambda c, n: F.when(~F.col("first"), F.round(exact(F.col(c)) - exact(F.lag(c).over(w)), n).cast("double"))
    return r.select("id", F.col("first").alias("is_first"), delta("total_files").alias("files_delta"), delta("organized_count").alias("organized_delta"), F.round(F.col("rate") - F.lag("rate").over(w), 1).alias("rate_delta"), since("total_cost", 4).alias("cost_delta"), since("total_processing_time_sec", 2).alias("time_delta"))


@query(CTE + "SELECT status, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(count(*) * 1.0 / max(count(*)) OVER (), 4) AS of_max FROM cur WHERE status IS NOT NULL GROUP BY 1")
def win_rank_share(s, d):
    n = files(s, d).where("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    w = W.partitionBy()
    return n.select("status", "files", F.round(100.0 * F.col("files") / F.sum("files").over(w), 4).alias("share"), F.round(F.col("files") / F.max("files").over(w), 4).alias("of_max"))


@query(
    CTE
    + r""", named AS (SELECT id, schema_type AS t, filename AS f, regexp_extract(filename, '(?s)^(.+?)((?:\.[^.]*)?)$', 1) AS stem, regexp_extract(filename, '(?s)^(.+?)((?:\.[^.]*)?)$', 2) AS suffix,
  row_number() OVER (PARTITION BY schema_type, filename ORDER BY id) - 1 AS n FROM cur WHERE filename IS NOT NULL AND trim(filename) <> ''),
taken AS (SELECT t, regexp_extract(stem, '(?s)^(.+)_([1-9][0-9]{0,16})$', 1) || suffix AS f, try_cast(regexp_extract(stem, '(?s)^(.+)_([1-9][0-9]{0,16})$', 2) AS BIGINT) AS k FROM named WHERE n = 0),
places AS (SELECT t, f, k - row_number() OVER (PARTITION BY t, f ORDER BY k) + 1 AS v, 0 AS kind, NULL AS id FROM taken WHERE k IS NOT NULL UNION ALL SELECT t, f, n, 1, id FROM named WHERE n > 0),
numbers AS (SELECT id, row_number() OVER (PARTITION BY t, f ORDER BY v, kind) AS k, kind FROM places)
SELECT n.id, CASE WHEN n.n = 0 THEN n.f ELSE n.stem || '_' || m.k || n.suffix END AS new_name FROM named n LEFT JOIN numbers m ON m.id = n.id AND m.kind = 1"""
)
def win_dedup_suffix(s, d):
    rows = files(s, d).where("filename is not null and trim(filename) <> ''")
    return op.numbered_names(s, rows.select("id", "schema_type", "filename"), "schema_type", "filename", [F.col("id")], "new_name").select("id", "new_name")


@query("SELECT id, name, level, full_path FROM categories ORDER BY level, name, id OFFSET 50 LIMIT 25")
def ord_page(s, d):
    return op.page(table(s, d, "categories"), [F.col("level"), F.col("name"), F.col("id")], 3, 25).select("id", "name", "level", "full_path")


@query("SELECT ceil(count(*) / 25.0)::BIGINT AS pages FROM categories")
def ord_page_count(s, d):
    return table(s, d, "categories").agg(F.ceil(F.count(F.lit(1)) / 25).alias("pages"))


@query("SELECT id, name FROM categories WHERE id > 100 ORDER BY id LIMIT 40")
def ord_kv_scan(s, d):
    return op.after_key(table(s, d, "categories").select("id", "name"), "id", 100, 40)


@query("SELECT id, name, file_count FROM categories ORDER BY file_count DESC NULLS LAST, id OFFSET 5 LIMIT 10")
def ord_offset_limit(s, d):
    return table(s, d, "categories").orderBy(F.col("file_count").desc_nulls_last(), "id").offset(5).limit(10).select("id", "name", "file_count")


@query("SELECT id, name FROM categories ORDER BY id LIMIT 7")
def ord_limit_noorder(s, d):
    """A limit without an order would be any rows; the key makes it defined."""
    return table(s, d, "categories").orderBy("id").limit(7).select("id", "name")


@query(CTE + "SELECT lower(file_extension) AS ext, count(*) AS files FROM cur GROUP BY 1 ORDER BY files DESC, ext LIMIT 5")
def ord_top_n(s, d):
    return files(s, d).groupBy(F.lower("file_extension").alias("ext")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), F.asc_nulls_last("ext")).limit(5)


@query("SELECT id, level, name FROM categories ORDER BY level, name, id")
def ord_tree(s, d):
    return table(s, d, "categories").orderBy("level", "name", "id").select("id", "level", "name")


@query(CTE + "SELECT status, count(*) AS files, count(*) FILTER (WHERE extracted_text_length > 0) AS with_text, count(*) FILTER (WHERE content_hash IS NULL) AS without_hash FROM cur GROUP BY 1")
def agg_org_summary(s, d):
    return files(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("extracted_text_length") > 0).alias("with_text"), F.count_if(F.col("content_hash").isNull()).alias("without_hash"))


@query(
    "SELECT 'files' AS relation, count(*) AS rows, count(*) FILTER (WHERE canonical_id IS NULL) AS without_id FROM files UNION ALL SELECT 'categories', count(*), count(*) FILTER (WHERE canonical_id IS NULL) FROM categories UNION ALL SELECT 'people', count(*), count(*) FILTER (WHERE canonical_id IS NULL) FROM people UNION ALL SELECT 'companies', count(*), count(*) FILTER (WHERE canonical_id IS NULL) FROM companies"
)
def agg_migration_verify(s, d):
    out = None
    for t in ("files", "categories", "people", "companies"):
        part = table(s, d, t).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("canonical_id").isNull()).alias("without_id")).withColumn("relation", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query(CTE + "SELECT count(*) FILTER (WHERE status = 'organized') AS organized, count(*) FILTER (WHERE status = 'already_organized') AS already, count(DISTINCT schema_type) AS kinds, count(*) FILTER (WHERE schema_type IS NOT NULL) AS with_schema FROM cur")
def agg_viewer_stats(s, d):
    st = F.col("status")
    return files(s, d).agg(F.count_if(st == "organized").alias("organized"), F.count_if(st == "already_organized").alias("already"), F.countDistinct("schema_type").alias("kinds"), F.count("schema_type").alias("with_schema"))


@query("SELECT id, filename, lower(status) AS status, file_size, db_updated_at FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY db_updated_at DESC NULLS LAST, status DESC NULLS LAST) = 1")
def snk_upsert_file(s, d):
    """Later deliveries of a file replace earlier ones: the early rows as base, the late ones as changes."""
    rows = table(s, d, "files").select("id", "filename", F.lower("status").alias("status"), "file_size", "db_updated_at")
    first = op.latest(rows.where("db_updated_at < timestamp_ntz'2024-01-01'"), ["id"], ["db_updated_at"])
    later = op.latest(rows.where("db_updated_at >= timestamp_ntz'2024-01-01' or db_updated_at is null"), ["id"], ["db_updated_at"])
    return op.upsert(first, later.where("db_updated_at is not null"), ["id"]).unionByName(later.where("db_updated_at is null").join(first, "id", "left_anti"))


@query("SELECT canonical_id, min(id) OVER (PARTITION BY canonical_id) AS survivor, id FROM people WHERE canonical_id IS NOT NULL QUALIFY id <> survivor")
def grf_merge(s, d):
    """Each row that another of its canonical id survives."""
    from ledgerloom.operators.graph import survivors_of_merge

    return survivors_of_merge(table(s, d, "people"))
