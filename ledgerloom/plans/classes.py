"""Queries of rule lists, descriptions, registries, corrections and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import paths
from ledgerloom.operators import feedback, rules
from ledgerloom.operators.catalog import nearest_entry
from ledgerloom.operators.rules import Rule
from ledgerloom.plans.analytics import _KV, _LOG, _kv, _log
from ledgerloom.plans.catalog import CTE, _PLACES, files, places
from ledgerloom.plans.scalars import _CASCADE_SQL, cascade
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


NAME_RULES = [
    Rule(r"\.log$|_log\b", "Technical", "Logs"),
    Rule(r"screenshot|bildschirmfoto|capture", "Media", "Screenshots"),
    Rule(r"invoice|rechnung|factura|receipt", "Financial", "Invoices"),
    Rule(r"contract|agreement|vertrag", "Legal", "Contracts"),
    Rule(r"^IMG_|^DSC_|^PXL_", "Media", "Photos", ignore_case=False),
    Rule(r"sprite|tile|frame_\d+", "GameAssets", "Sprites"),
    Rule(r"r[ée]sum[ée]|lebenslauf|\bcv\b", "Personal", "Resumes"),
    Rule(r"report|protokoll|minutes", "Documents", "Reports"),
]
EXT_RULES = {".pdf": ("Documents", "PDF"), ".docx": ("Documents", "Word"), ".xlsx": ("Documents", "Sheets"), ".png": ("Media", "Images"), ".jpg": ("Media", "Images"), ".mp3": ("Media", "Audio"), ".mov": ("Media", "Video"), ".py": ("Technical", "Code"), ".json": ("Data", "JSON"), ".zip": ("Archives", "Zip"), ".ttf": ("Fonts", "TrueType"), ".otf": ("Fonts", "OpenType")}
PATH_RULES = [Rule(r"/camera/", "Media", "Camera", column="original_path")]


def _rule_sql(rs: list[Rule], what: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({r.column}, '{'(?i)' if r.ignore_case else ''}{r.pattern}') THEN '{getattr(r, what)}'" for r in rs) + " END"


def _ext_sql(i: int) -> str:
    return "CASE lower(file_extension) " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in EXT_RULES.items()) + " END"


@query(
    CTE
    + f"SELECT id, coalesce({_rule_sql(NAME_RULES, 'category')}, {_ext_sql(0)}, {_rule_sql(PATH_RULES, 'category')}, 'Uncategorized') AS category, coalesce({_rule_sql(NAME_RULES, 'subcategory')}, {_ext_sql(1)}, {_rule_sql(PATH_RULES, 'subcategory')}, 'Other') AS subcategory FROM cur"
)
def cls_name(s, d):
    """cls_name_filename, cls_name_ext, cls_name_path: by name, then extension, then path."""
    other = F.struct(F.lit("Uncategorized").alias("category"), F.lit("Other").alias("subcategory"))
    c = F.coalesce(rules.classified(NAME_RULES), rules.looked_up(F.lower("file_extension"), EXT_RULES), rules.classified(PATH_RULES), other)
    return files(s, d).select("id", c.alias("c")).select("id", "c.category", "c.subcategory")


_WORDS = {"Nonprofit": ["branch office", "records committee"], "Business": ["contract", "invoices", "supplier"], "School": ["lecture", "students"]}
_HITS = lambda ws: " + ".join(f"contains(t, '{w}')::INT" for w in ws)


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN {_HITS(ws)} >= 2 THEN '{k}'" for k, ws in _WORDS.items()) + " END AS class FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) >= 50)")
def cls_org(s, d):
    """The first class with two of its keywords in a text of 50 characters or more."""
    return table(s, d, "documents").where(F.length("text") >= 50).select("doc_id", rules.keyword_class(F.lower("text"), _WORDS, 2).alias("class"))


@query("SELECT doc_id, coalesce(CASE WHEN contains(lower(text), 'r' || chr(233) || 'sum' || chr(233)) THEN 'resume' END, CASE WHEN contains(lower(text), 'session closed') THEN 'log' END, CASE WHEN regexp_matches(text, '^number;') THEN 'sheet' END, CASE WHEN regexp_matches(text, '(?i)kind regards|best wishes') THEN 'letter' END, 'text') AS class FROM documents")
def cls_content_cascade(s, d):
    low = F.lower("text")
    return table(s, d, "documents").select(
        "doc_id",
        F.coalesce(F.when(low.contains("résumé"), "resume"), F.when(low.contains("session closed"), "log"), F.when(F.col("text").rlike("^number;"), "sheet"), F.when(F.col("text").rlike("(?i)kind regards|best wishes"), "letter"), F.lit("text")).alias("class"),
    )


@query("SELECT vec_id, CASE WHEN greatest(embedding[1], embedding[2], embedding[3], 0) > 0.3 THEN 'interior' WHEN greatest(embedding[4], 0) > 0.15 AND true THEN 'people' ELSE 'other' END AS class FROM embeddings")
def cls_vision_rules(s, d):
    """Thresholds on a map of scores; where the scores come from is not this engine's matter."""
    scores = F.map_from_arrays(F.array(*[F.lit(f"s{i}") for i in range(4)]), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return table(s, d, "embeddings").select("vec_id", rules.by_thresholds(scores, [("interior", ["s0", "s1", "s2"], 0.3), ("people", ["s3"], 0.15)], "other").alias("class"))


@query(CTE + r"SELECT id, coalesce(nullif(regexp_extract(filename, '^(\d+)_', 1), ''), '-') AS number FROM cur WHERE filename IS NOT NULL")
def cls_number_icon(s, d):
    return files(s, d).where("filename is not null").select("id", F.coalesce(F.nullif(F.regexp_extract("filename", r"^(\d+)_", 1), F.lit("")), F.lit("-")).alias("number"))


@query(CTE + "SELECT id, CASE WHEN regexp_matches(lower(filename), 'theme|music|loop') THEN 'music' WHEN regexp_matches(lower(filename), 'tile|texture') THEN 'texture' WHEN regexp_matches(lower(filename), 'sprite|frame') THEN 'sprite' ELSE 'other' END AS kind FROM (SELECT id, regexp_replace(filename, '_[0-9]{8}_[0-9]{6}', '') AS filename FROM cur WHERE filename IS NOT NULL)")
def cls_game(s, d):
    """cls_game and cls_game_sub, on the stem without a time stamp."""
    low = F.lower(F.regexp_replace("filename", "_[0-9]{8}_[0-9]{6}", ""))
    return files(s, d).where("filename is not null").select("id", F.when(low.rlike("theme|music|loop"), "music").when(low.rlike("tile|texture"), "texture").when(low.rlike("sprite|frame"), "sprite").otherwise("other").alias("kind"))


@query(CTE + f"SELECT id, {_CASCADE_SQL} AS class, CASE {_CASCADE_SQL} WHEN 'Screenshots' THEN 0.9 WHEN 'Sprites' THEN 0.8 WHEN 'Other' THEN 0.1 ELSE 0.7 END AS confidence FROM cur")
def cls_eval_model(s, d):
    c = F.col("class")
    return files(s, d).select("id", cascade().alias("class")).select("id", "class", F.when(c == "Screenshots", 0.9).when(c == "Sprites", 0.8).when(c == "Other", 0.1).otherwise(0.7).alias("confidence"))


@query(
    _LOG
    + ", c AS (SELECT hash, max({'seen': seen, 'id': id, 'category': category}) AS r FROM log WHERE hash IS NOT NULL GROUP BY 1) SELECT u.id, CASE WHEN c.hash IS NOT NULL THEN c.r.category ELSE u.schema_type END AS category, CASE WHEN c.hash IS NOT NULL THEN 1.0 ELSE 0.5 END AS confidence FROM cur u LEFT JOIN c ON c.hash = u.content_hash"
)
def cls_feedback_apply(s, d):
    """A correction of the same content comes before any other class."""
    last = feedback.current_corrections(_log(s, d).where("hash is not null").drop("patterns")).select("hash", F.col("category").alias("corrected"))
    j = files(s, d).join(last, F.col("content_hash") == F.col("hash"), "left")
    return j.select("id", F.coalesce("corrected", "schema_type").alias("category"), F.when(F.col("hash").isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


@query(_LOG + ", c AS (SELECT * FROM log WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seen DESC, id DESC) = 1) SELECT hash, category FROM c WHERE hash NOT IN (SELECT hash FROM log WHERE category = 'Dataset' AND hash IS NOT NULL)")
def dml_remove_correction(s, d):
    """dml_add_correction keeps a log, of which the last entry per content holds; removing is an anti-join on that view."""
    log = _log(s, d).where("hash is not null")
    return feedback.current_corrections(log.drop("patterns")).select("hash", "category").join(log.where("category = 'Dataset'").select("hash").distinct(), "hash", "left_anti")


@query(_LOG + "SELECT count(*) AS corrections, count(DISTINCT hash) AS contents, (SELECT count(DISTINCT pattern) FROM votes) AS patterns, max(seen) AS last FROM log")
def agg_feedback_stats(s, d):
    log = _log(s, d)
    n = feedback.pattern_votes(log).agg(F.countDistinct("pattern").alias("patterns")).first().patterns
    return log.agg(F.count(F.lit(1)).alias("corrections"), F.countDistinct("hash").alias("contents"), F.max("at").alias("last")).withColumn("patterns", F.lit(n).cast("bigint"))


@query(_LOG + "SELECT '- ' || pattern || ': ' || category || ' (' || votes || ')' AS line FROM votes")
def rpt_corrections(s, d):
    """rpt_text: reports are text columns over aggregates."""
    v = feedback.pattern_votes(_log(s, d))
    return v.select(F.concat(F.lit("- "), "pattern", F.lit(": "), "category", F.lit(" ("), F.col("votes").cast("string"), F.lit(")")).alias("line"))


@query("WITH found AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+ (?:Ltd|Inc|LLC|GmbH|Corp|BV|SA)'))) AS name FROM documents), firms AS (SELECT min(id) AS id, lower(trim(name)) AS name FROM companies WHERE name IS NOT NULL GROUP BY 2) SELECT doc_id, id AS company_id FROM found JOIN firms USING (name)")
def jn_file_company(s, d):
    """Documents with the firms that they name: extracted names against normalised ones."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+ (?:Ltd|Inc|LLC|GmbH|Corp|BV|SA)"), F.lit(0)))
    each = table(s, d, "documents").select("doc_id", F.explode(found).alias("n")).select("doc_id", F.lower("n").alias("name")).distinct()
    firms = table(s, d, "companies").where("name is not null").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("company_id"))
    return each.join(firms, "name").select("doc_id", "company_id")


@query(_PLACES + "SELECT p.id, arg_min(g.name, abs(p.lat - g.lat) + abs(p.lon - g.lon)) AS near FROM places p JOIN places g ON g.id <= 20 WHERE abs(p.lat - g.lat) < 3 AND abs(p.lon - g.lon) < 3 GROUP BY 1")
def fn_reverse_geocode(s, d):
    """The nearest entry of a gazetteer within three degrees: cells, then the least distance."""
    from ledgerloom.operators.catalog import near_join

    p = places(s, d)
    gaz = p.where("id <= 20")
    pairs = near_join(p.select("id", "lat", "lon"), gaz.select("id", "lat", "lon"), 3.0).join(gaz.select(F.col("id").alias("id_b"), "name"), "id_b")
    dist = F.abs(F.col("lat_a") - F.col("lat_b")) + F.abs(F.col("lon_a") - F.col("lon_b"))
    return pairs.groupBy(F.col("id_a").alias("id")).agg(F.min_by("name", dist).alias("near"))


@query()
def fn_reverse_geocode_all(s, d):
    """fn_reverse_geocode with the whole table as gazetteer. Without SQL, whose join of all pairs is too slow; tested by brute force."""
    p = places(s, d)
    return nearest_entry(p, p, 3.0)


@query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[:3], lambda x: trim(x)), lambda x: length(x) > 10 AND length(x) < 50)[1] AS phrase FROM documents")
def fn_ocr_phrase(s, d):
    """The first of three lines with more than 10 and fewer than 50 characters."""
    lines = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 3), F.trim), lambda x: (F.length(x) > 10) & (F.length(x) < 50))
    return table(s, d, "documents").select("doc_id", F.try_element_at(lines, F.lit(1)).alias("phrase"))


@query(CTE + r"SELECT id, concat_ws('_', strftime(created_at, '%Y%m%d'), substr(lower(coalesce(schema_type, 'file')), 1, 3), nullif(array_to_string(list_filter(regexp_extract_all(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '[A-Za-z]+'), lambda w: length(w) >= 3)[:2], '_'), '')) AS name FROM cur")
def fn_descriptive_name(s, d):
    words = F.filter(F.regexp_extract_all(paths.stem(F.col("filename")), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return files(s, d).select("id", F.concat_ws("_", F.date_format("created_at", "yyyyMMdd"), F.substring(F.lower(F.coalesce("schema_type", F.lit("file"))), 1, 3), F.nullif(F.array_join(F.slice(words, 1, 2), "_"), F.lit(""))).alias("name"))


@query("SELECT id, 'https://example.org/people/' || canonical_id AS url, 'urn:uuid:' || canonical_id AS iri FROM people WHERE canonical_id IS NOT NULL")
def fn_entity_url(s, d):
    """fn_entity_url, fn_iri_of, fn_entity_uuid."""
    return table(s, d, "people").where("canonical_id is not null").select("id", F.concat(F.lit("https://example.org/people/"), "canonical_id").alias("url"), F.concat(F.lit("urn:uuid:"), "canonical_id").alias("iri"))


@query("SELECT DISTINCT ts, regexp_replace(strftime(ts, '%Y:%m:%d %H:%M:%S'), '^(\\d+):(\\d+):', '\\1-\\2-') AS iso FROM events")
def fn_exif_dt_iso(s, d):
    return table(s, d, "events").select("ts", F.regexp_replace(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), r"^(\d+):(\d+):", "$1-$2-").alias("iso")).distinct()


@query("SELECT doc_id, substr(text, 1, 1000) || CASE WHEN length(text) > 1000 THEN '...' ELSE '' END AS abstract, lang FROM documents")
def fn_schema_content(s, d):
    """An abstract is a feature of the document; the whole text stays in its own column."""
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.concat(F.substring(t, 1, 1000), F.when(F.length(t) > 1000, "...").otherwise("")).alias("abstract"), "lang")


@query(_KV + "SELECT namespace, key FROM kv WHERE namespace = 'click' AND key > 'user:2' ORDER BY key LIMIT 15")
def kv_scan(s, d):
    """A cursor over keys."""
    from ledgerloom.operators.catalog import after_key

    return after_key(_kv(s, d).where("namespace = 'click'").select("namespace", "key"), "key", "user:2", 15)


@query("SELECT json_object('status', 'ok', 'count', count(*)) AS body FROM categories")
def fn_api_response(s, d):
    return table(s, d, "categories").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("count"))).alias("body"))


@query(CTE + "SELECT level, property, count(*) AS n FROM (SELECT 'warning' AS level, 'name' AS property FROM cur WHERE schema_type = 'ImageObject' AND filename IS NULL UNION ALL SELECT 'info', 'width' FROM cur WHERE schema_type = 'ImageObject' AND image_width IS NULL UNION ALL SELECT 'warning', 'contentUrl' FROM cur WHERE schema_type = 'ImageObject' AND current_path IS NULL) GROUP BY 1, 2")
def val_rich_results(s, d):
    """Checks that hold for one type only."""
    from ledgerloom.operators import validation as v

    f = files(s, d).where("schema_type = 'ImageObject'")
    checks = [v.message(F.col("filename").isNull(), "warning", "missing", "name"), v.message(F.col("image_width").isNull(), "info", "recommended", "width"), v.message(F.col("current_path").isNull(), "warning", "missing", "contentUrl")]
    return v.validated(f, checks).select(F.explode("messages").alias("m")).groupBy("m.level", "m.property").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT error, n FROM (SELECT 'E' || event_id % 4 AS error, count(*) AS n FROM events GROUP BY 1) ORDER BY CASE error WHEN 'E3' THEN 0 WHEN 'E1' THEN 1 ELSE 2 END, n DESC, error")
def ord_severity(s, d):
    """An order by a rank of labels, then by size."""
    rank = F.when(F.col("error") == "E3", 0).when(F.col("error") == "E1", 1).otherwise(2)
    return table(s, d, "events").groupBy(F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")).alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(rank, F.desc("n"), "error")


@query(CTE + "SELECT count(*) AS rows, count(DISTINCT id) AS ids FROM cur")
def src_sqlite(s, d):
    """A table scan."""
    return files(s, d).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


_FONT = "CASE WHEN lower(file_extension) IN ('.ttf', '.otf', '.woff', '.woff2') THEN CASE WHEN regexp_matches(lower(filename), 'bold') THEN 'Bold' WHEN regexp_matches(lower(filename), 'italic|oblique') THEN 'Italic' ELSE 'Regular' END END"


@query(CTE + f"SELECT id, {_FONT} AS face FROM cur WHERE filename IS NOT NULL")
def cls_font(s, d):
    """Fonts by extension, then by the face in their name."""
    faces = [Rule("bold", "Fonts", "Bold"), Rule("italic|oblique", "Fonts", "Italic")]
    face = F.coalesce(rules.classified(faces)["subcategory"], F.lit("Regular"))
    return files(s, d).where("filename is not null").select("id", F.when(F.lower("file_extension").isin(".ttf", ".otf", ".woff", ".woff2"), face).alias("face"))


@query(CTE + "SELECT id, CASE WHEN regexp_matches(lower(original_path), '/(camera|photos?)/') THEN 'Photos' WHEN regexp_matches(lower(original_path), '/(mailroom|inbox)/') THEN 'Mail' WHEN regexp_matches(lower(original_path), '/desk[^/]*/') THEN 'Desk' ELSE 'Elsewhere' END AS place, len(string_split(original_path, '/')) - 2 AS folders FROM cur")
def cls_filepath(s, d):
    """A class from the folders that a file lies in."""
    rs = [Rule("/(camera|photos?)/", "Photos", "", "original_path"), Rule("/(mailroom|inbox)/", "Mail", "", "original_path"), Rule("/desk[^/]*/", "Desk", "", "original_path")]
    return files(s, d).select("id", F.coalesce(rules.classified(rs)["category"], F.lit("Elsewhere")).alias("place"), (F.size(F.split("original_path", "/")) - 2).cast("bigint").alias("folders"))


_ROLES = {"Medical": ["patient", "doctor", "prescription"], "Personal": ["birthday", "passport", "family"], "Letter": ["dear", "regards", "sincerely", "wishes"]}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_HITS(ws)} >= 1 THEN '{k}'" for k, ws in _ROLES.items()) + " END AS class, len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) > 0 AS names_someone FROM (SELECT doc_id, text, lower(text) AS t FROM documents WHERE length(text) >= 20)")
def cls_person(s, d):
    """Texts about persons: the first class with one of its keywords, and whether anyone is named."""
    t = table(s, d, "documents").where(F.length("text") >= 20)
    return t.select("doc_id", rules.keyword_class(F.lower("text"), _ROLES, 1).alias("class"), (F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))) > 0).alias("names_someone"))


_FOLDERS = {"ImageObject": "Pictures", "Dataset": "Data", "DigitalDocument": "Papers"}
_FOLDER_SQL = "CASE schema_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOLDERS.items()) + " ELSE 'Other' END"


@query(CTE + f"SELECT id, 'Sorted/' || {_FOLDER_SQL} || '/' || CASE WHEN extracted_text_length > 0 THEN 'with text' ELSE 'other' END AS folder FROM cur")
def cls_content_folder(s, d):
    """fn_dest_simple: class and finer class to a folder, with a folder for the rest."""
    m = F.create_map(*[F.lit(x) for kv in _FOLDERS.items() for x in kv])
    return files(s, d).select("id", F.concat_ws("/", F.lit("Sorted"), F.coalesce(F.try_element_at(m, F.col("schema_type")), F.lit("Other")), F.when(F.col("extracted_text_length") > 0, "with text").otherwise("other")).alias("folder"))


_TOP_SQL = "list_sort(list_transform(range(0, len(embedding)), lambda i: {'v': -embedding[i + 1], 'i': i}))"


@query(f"SELECT vec_id, 'class ' || t[1].i || ' (' || printf('%.2f', -t[1].v) || ') | ' || array_to_string(list_transform(t[2:3], lambda x: 'class ' || x.i), ', ') AS description FROM (SELECT vec_id, {_TOP_SQL} AS t FROM embeddings)")
def fn_describe_image(s, d):
    """Best class with its score, then the next two, from a vector of scores (where the scores come from is not this engine's matter)."""
    top = F.array_sort(F.transform("embedding", lambda x, i: F.struct((-x).alias("v"), i.cast("bigint").alias("i"))))
    best = F.format_string("class %d (%.2f)", F.col("t")[0]["i"], -F.col("t")[0]["v"].cast("double"))
    return table(s, d, "embeddings").select("vec_id", top.alias("t")).select("vec_id", F.concat_ws(" | ", best, F.array_join(F.transform(F.slice("t", 2, 2), lambda x: F.concat(F.lit("class "), x["i"].cast("string"))), ", ")).alias("description"))


_OUTCOME = "CASE WHEN filename IS NULL THEN 'missing' WHEN schema_type IS NULL THEN 'no type' WHEN starts_with(lower(filename), lower(substr(schema_type, 1, 3))) THEN 'unchanged' ELSE 'renamed' END"


@query(CTE + f"SELECT {_OUTCOME} AS outcome, count(*) AS files FROM cur GROUP BY 1")
def fn_rename_with_descriptions(s, d):
    """Outcomes of a renaming by description."""
    f, t = F.col("filename"), F.col("schema_type")
    outcome = F.when(f.isNull(), "missing").when(t.isNull(), "no type").when(F.startswith(F.lower(f), F.lower(F.substring(t, 1, 3))), "unchanged").otherwise("renamed")
    return files(s, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


@query(CTE + r"SELECT id, 'Screenshots/' || CASE WHEN regexp_matches(lower(filename), 'capture') THEN 'Captures' ELSE 'Other' END AS folder, CASE WHEN regexp_matches(lower(filename), 'capture') THEN 'cap' ELSE 'shot' END || '_' || substr(md5(filename), 1, 8) || regexp_extract(filename, '^.+(\.[^.]+)$', 1) AS new_name FROM cur WHERE regexp_matches(lower(filename), 'screenshot|bildschirmfoto|capture')")
def fn_screenshot_plan(s, d):
    """Folder and a name of prefix, hash and suffix for each screenshot."""
    low = F.lower("filename")
    cap = low.rlike("capture")
    return files(s, d).where(low.rlike("screenshot|bildschirmfoto|capture")).select("id", F.when(cap, "Screenshots/Captures").otherwise("Screenshots/Other").alias("folder"), F.concat(F.when(cap, "cap").otherwise("shot"), F.lit("_"), F.substring(F.md5("filename"), 1, 8), paths.suffix(F.col("filename"))).alias("new_name"))
