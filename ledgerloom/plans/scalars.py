"""Queries of the scalar functions over the files table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import ids, paths, text
from ledgerloom.plans.catalog import CTE, files
from ledgerloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    CTE
    + r"SELECT id, split_part(original_path, '/', -1) AS name, regexp_extract(split_part(original_path, '/', -1), '^.+(\.[^.]+)$', 1) AS suffix, regexp_extract(split_part(original_path, '/', -1), '^.+?(\.[^.]+\.[^.]+)$', 1) AS double_suffix, regexp_replace(split_part(original_path, '/', -1), '^(.+)\.[^.]+$', '\1') AS stem, split_part(original_path, '/', -2) AS parent, length(original_path) - length(replace(original_path, '/', '')) AS depth FROM cur"
)
def fn_path_parts(s, d):
    """fn_basename, fn_suffix, fn_double_suffix, fn_stem, fn_parent, fn_depth."""
    p, n = F.col("original_path"), paths.basename(F.col("original_path"))
    return files(s, d).select("id", n.alias("name"), paths.suffix(n).alias("suffix"), paths.double_suffix(n).alias("double_suffix"), paths.stem(n).alias("stem"), paths.parent(p).alias("parent"), paths.depth(p).alias("depth"))


#: Folders that name no project.
GENERIC = [
    "src", "lib", "bin", "dist", "build", "out", "target", "node_modules", "venv", ".venv", "env", "__pycache__", "scripts", "tests", "test", "docs", "doc", "examples",
    "static", "public", "assets", "resources", "config", "home", "users", "documents", "downloads", "desktop", "code", "projects", "dev", "work", "repos", "git",
]


@query(
    CTE
    + f"SELECT id, list_filter(list_reverse(string_split(original_path, '/')[:-2]), lambda x: x <> '' AND NOT starts_with(x, '.') AND lower(x) NOT IN ({', '.join(repr(g) for g in GENERIC)}))[1] AS project FROM cur"
)
def fn_project_name(s, d):
    return files(s, d).select("id", paths.project_folder(F.col("original_path"), GENERIC).alias("project"))


@query(
    CTE
    + r"""SELECT id, trim(substr(trim(regexp_replace(regexp_replace(filename, '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), 1, 50)) AS folder,
  rtrim(substr(regexp_replace(regexp_replace(trim(regexp_replace(filename, '[^\w\s-]', '', 'g')), '\s+', '_', 'g'), '_+', '_', 'g'), 1, 40), '_') AS file FROM cur"""
)
def fn_sanitize(s, d):
    """fn_sanitize_folder and fn_sanitize_filename."""
    return files(s, d).select("id", paths.clean_folder(F.col("filename")).alias("folder"), paths.clean_filename(F.col("filename"), 40).alias("file"))


#: Classes of file extensions.
EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif", "svg", "tiff", "ico"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "m4v"],
    "audio": ["mp3", "wav", "ogg", "flac", "aac", "m4a"],
    "document": ["pdf", "doc", "docx", "rtf", "odt"],
    "text": ["txt"],
    "spreadsheet": ["xls", "xlsx"],
    "data": ["csv", "json", "xml", "yaml", "yml"],
    "code": ["py", "js", "ts", "jsx", "tsx", "html", "css"],
    "archive": ["zip", "tar", "gz", "rar", "7z"],
}
_EXT = {f".{e}": k for k, v in EXTENSIONS.items() for e in v}
_EXT_SQL = "CASE lower(file_extension) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in _EXT.items()) + " ELSE 'other' END"


def extension_class(ext) -> F.Column:
    m = F.create_map(*[F.lit(x) for kv in _EXT.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(ext)), F.lit("other"))


@query(CTE + f"SELECT id, {_EXT_SQL} AS class FROM cur")
def fn_ext_category(s, d):
    return files(s, d).select("id", extension_class(F.col("file_extension")).alias("class"))


@query(CTE + "SELECT id, CASE WHEN starts_with(mime_type, 'image/') THEN 'ImageObject' WHEN starts_with(mime_type, 'video/') THEN 'VideoObject' WHEN starts_with(mime_type, 'audio/') THEN 'AudioObject' ELSE 'DigitalDocument' END AS kind FROM cur")
def fn_schema_type(s, d):
    m = F.col("mime_type")
    rules = [(m.startswith("image/"), F.lit("ImageObject")), (m.startswith("video/"), F.lit("VideoObject")), (m.startswith("audio/"), F.lit("AudioObject"))]
    return files(s, d).select("id", text.first_match(rules, F.lit("DigitalDocument")).alias("kind"))


#: The words of a file name: letters with accents as letter and mark, capitals before a capitalised word apart.
TOKENS_SQL = r"list_filter(list_transform(flatten(list_transform(regexp_split_to_array(array_to_string(list_transform(string_split(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || chr(769) ELSE c END), ''), '[_\-\s.]+'), lambda w: CASE WHEN regexp_matches(w, '[A-Za-z0-9]') THEN regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') ELSE [w] END)), lambda w: lower(w)), lambda w: length(w) > 1)"


@query(CTE + f"SELECT id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM cur WHERE filename IS NOT NULL")
def fn_tokenize(s, d):
    return files(s, d).where("filename is not null").select("id", F.array_join(paths.tokens(F.col("filename")), " ").alias("tokens"))


#: File names that begin with a date, and labels of file names.
DATES = [r"^\d{8}", r"^\d{4}-\d{2}-\d{2}", r"^\d{2}-\d{2}-\d{4}", r"^20\d{2}\d{4}"]
NAMES = {
    "screenshot_prefix": r"^screenshot", "img_prefix": r"^img_", "pixel_prefix": r"^pxl_", "dsc_prefix": r"^dsc_", "frame_pattern": r"frame\d*", "sprite_keyword": r"sprite", "texture_keyword": r"texture",
    "audio_keyword": r"audio|sound|sfx", "music_keyword": r"music|bgm|ost", "icon_keyword": r"icon", "button_keyword": r"button", "tile_keyword": r"tile", "environment_keyword": r"wall|floor|door",
    "character_keyword": r"character|player|enemy", "weapon_keyword": r"weapon|sword|bow|axe", "item_keyword": r"item|potion|scroll", "ui_prefix": r"ui_|gui_|hud_", "timestamp_pattern": r"\d{8}_\d{6}",
    "whatsapp_keyword": r"whatsapp", "chatgpt_keyword": r"chatgpt", "financial_keyword": r"invoice|receipt", "legal_keyword": r"contract|agreement", "employment_keyword": r"resume|cv",
}
_SUFFIX_SQL = r"lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1))"
LABELS_SQL = "list_concat(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(filename), '{p}') THEN '{k}' END" for k, p in NAMES.items()) + f"], lambda x: x IS NOT NULL), CASE WHEN {_SUFFIX_SQL} <> '' THEN ['ext:' || {_SUFFIX_SQL}] ELSE [] END)"


def name_patterns(name: F.Column) -> F.Column:
    """Labels of a file name, with its extension as the last."""
    ext = F.lower(paths.suffix(name))
    return F.concat(text.labels(F.lower(name), NAMES), F.when(ext != "", F.array(F.concat(F.lit("ext:"), ext))).otherwise(F.array().cast("array<string>")))


@query(CTE + "SELECT id, regexp_matches(filename, '" + "|".join(f"(?:{p})" for p in DATES) + "') AS dated FROM cur")
def fn_starts_with_date(s, d):
    return files(s, d).select("id", text.matches_any(F.col("filename"), DATES).alias("dated"))


@query(CTE + f"SELECT id, array_to_string({LABELS_SQL}, ',') AS labels FROM cur WHERE filename IS NOT NULL")
def fn_patterns_of_name(s, d):
    return files(s, d).where("filename is not null").select("id", F.array_join(name_patterns(F.col("filename")), ",").alias("labels"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::INT AS the, ((length(text) - length(replace(text, 'office', ''))) / 6)::INT AS office FROM documents")
def fn_count_keyword(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", text.count_of(t, "the").alias("the"), text.count_of(t, "office").alias("office"))


@query(CTE + "SELECT id, sha256(original_path) AS file_id, 'urn:sha256:' || sha256(original_path) AS iri, substr(md5(original_path), 1, 8) AS md5_8 FROM cur")
def fn_sha256(s, d):
    """fn_sha256, fn_md5_8 and the IRI of a file."""
    p = F.col("original_path")
    return files(s, d).select("id", ids.file_id(p).alias("file_id"), ids.file_iri(p).alias("iri"), F.substring(F.md5(p), 1, 8).alias("md5_8"))


@query(
    "SELECT id, "
    + _UUID5
    + r" AS made FROM (SELECT id, sha1(unhex('d1e2a3b456789abcdef0123456789012') || encode(regexp_replace(lower(name), '^\s+|\s+$', '', 'g'))) AS h FROM people WHERE name IS NOT NULL)"
)
def fn_uuid5(s, d):
    return table(s, d, "people").where("name is not null").select("id", ids.uuid5(ids.NAMESPACES["person"], ids.normalized(F.col("name"))).alias("made"))


@query(
    "WITH v AS (SELECT DISTINCT session_id AS v FROM files UNION SELECT DISTINCT content_hash FROM files UNION SELECT DISTINCT canonical_id FROM files UNION SELECT DISTINCT name FROM companies), w AS (SELECT v, trim(v) AS t FROM v), x AS (SELECT *, sha1(unhex('f4e8a9c0123456789abcdef012345678') || encode(t)) AS h FROM w)\n"
    + f"SELECT v, CASE WHEN regexp_matches(t, '^(urn:|https?://|ftp://|file://|mailto:|data:)') THEN t WHEN regexp_matches(lower(t), '{ids.UUID}') THEN 'urn:uuid:' || lower(t) WHEN regexp_matches(lower(t), '^[0-9a-f]{{64}}$') THEN 'urn:sha256:' || lower(t) ELSE 'urn:uuid:' || {_UUID5} END AS iri FROM x WHERE v IS NOT NULL"
)
def fn_normalize_iri(s, d):
    """fn_normalize_iri, with the tests of fn_is_valid_iri and fn_extract_uuid in it."""
    f = table(s, d, "files")
    v = f.select("session_id").union(f.select("content_hash")).union(f.select("canonical_id")).union(table(s, d, "companies").select("name")).distinct().toDF("v").where("v is not null")
    return v.select("v", ids.to_iri(F.col("v")).alias("iri"))


@query(CTE + r"SELECT id, replace(replace(replace(replace(replace(filename, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM cur".replace('\\"', '"'))
def fn_html_escape(s, d):
    return files(s, d).select("id", text.html_escaped(F.col("filename")).alias("escaped"))


@query("SELECT id, CASE WHEN t < 60 THEN printf('%.1fs', t) WHEN t < 3600 THEN printf('%.1f min', t / 60) ELSE printf('%.1f h', t / 3600) END AS shown FROM (SELECT DISTINCT id, total_processing_time_sec AS t FROM organization_sessions) WHERE t IS NOT NULL")
def fn_format_duration(s, d):
    return table(s, d, "organization_sessions").where("total_processing_time_sec is not null").select("id", text.duration_text(F.col("total_processing_time_sec")).alias("shown"), "total_processing_time_sec").distinct().drop("total_processing_time_sec")


@query(
    "SELECT DISTINCT t, CASE WHEN t = 0 THEN 'PT0S' ELSE 'PT' || CASE WHEN t // 3600 > 0 THEN (t // 3600) || 'H' ELSE '' END || CASE WHEN t % 3600 // 60 > 0 THEN (t % 3600 // 60) || 'M' ELSE '' END || CASE WHEN t % 60 > 0 THEN (t % 60) || 'S' ELSE '' END END AS iso FROM (SELECT floor(total_processing_time_sec)::BIGINT AS t FROM organization_sessions) WHERE t IS NOT NULL"
)
def fn_iso_duration(s, d):
    t = F.floor("total_processing_time_sec")
    return table(s, d, "organization_sessions").select(t.alias("t")).where("t is not null").distinct().select("t", text.iso_duration(F.col("t")).alias("iso"))


@query(CTE + "SELECT id, strftime(created_at, '%Y:%m:%d %H:%M:%S') AS exif, date_trunc('second', created_at) AS seen, strftime(created_at, '%Y-%m') AS month, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM cur WHERE created_at IS NOT NULL")
def fn_exif_dt(s, d):
    """fn_exif_dt, fn_report_ts and fn_isoformat: texts of dates to times and back."""
    exif = F.date_format("created_at", "yyyy:MM:dd HH:mm:ss")
    return files(s, d).where("created_at is not null").select("id", exif.alias("exif"), text.exif_time(exif).cast("timestamp_ntz").alias("seen"), F.date_format("created_at", "yyyy-MM").alias("month"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 - v ELSE v END AS degrees FROM (SELECT c_custkey, round(c_custkey % 90 + (c_custkey % 60) / 60 + (c_custkey % 55) / 3600, 9) AS v FROM customer)")
def fn_dms_to_deg(s, d):
    c = F.col("c_custkey")
    ref = F.when(c % 2 == 0, "S").otherwise("N")
    return table(s, d, "customer").select("c_custkey", F.round(text.degrees(c % 90, c % 60, c % 55, ref), 9).alias("degrees"))


@query(CTE + "SELECT id, upper(status[1]) || status[2:] AS one, array_to_string(list_transform(string_split(status, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM cur WHERE status IS NOT NULL")
def fn_title_label(s, d):
    return files(s, d).where("status is not null").select("id", F.concat(F.upper(F.substring("status", 1, 1)), F.substring("status", F.lit(2), F.length("status"))).alias("one"), text.title_label(F.col("status")).alias("label"))


_REQ, _REC = ["filename", "mime_type", "content_hash"], ["image_width", "has_faces"]


@query(
    CTE
    + "SELECT id, round(least(((filename IS NOT NULL)::INT + (mime_type IS NOT NULL)::INT + (content_hash IS NOT NULL)::INT + 0.5 * ((image_width IS NOT NULL)::INT + (has_faces IS NOT NULL)::INT)) / 3, 1), 6) AS score, array_to_string(list_filter([CASE WHEN filename IS NULL THEN 'filename' END, CASE WHEN mime_type IS NULL THEN 'mime_type' END, CASE WHEN content_hash IS NULL THEN 'content_hash' END], lambda x: x IS NOT NULL), ',') AS missing FROM cur"
)
def fn_completion_score(s, d):
    """fn_completion_score and fn_missing_required."""
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in (*_REQ, *_REC)]))
    return files(s, d).select("id", F.round(text.completeness(present, _REQ, _REC), 6).alias("score"), F.array_join(text.missing(present, _REQ), ",").alias("missing"))


@query(
    CTE
    + "SELECT id, coalesce(current_path, original_path) AS path, coalesce(mime_type, 'application/octet-stream') AS mime FROM cur"
)
def fn_merge_metadata(s, d):
    """Later maps win unless their value is null."""
    m = lambda p, t: F.create_map(F.lit("path"), p, F.lit("mime"), t)
    out = text.merged(m(F.col("original_path"), F.lit("application/octet-stream")), m(F.col("current_path"), F.col("mime_type")))
    return files(s, d).select("id", out["path"].alias("path"), out["mime"].alias("mime"))


@query("SELECT id, len(json_extract(source_directories, '$[*]')) AS n, json_extract_string(source_directories, '$[0]') AS first FROM (SELECT DISTINCT id, source_directories FROM organization_sessions)")
def fn_schema_get(s, d):
    """fn_schema_get, fn_first_n, fn_len: fields of JSON texts."""
    j = F.col("source_directories")
    return table(s, d, "organization_sessions").select("id", j).distinct().select("id", F.coalesce(F.json_array_length(j), F.lit(0)).cast("bigint").alias("n"), F.get_json_object(j, "$[0]").alias("first"))


#: What a scan leaves out, and hidden files that it keeps.
SKIP_FILES = [".DS_Store", ".localized", "Thumbs.db", "desktop.ini"]
SKIP_FOLDERS = ["__pycache__", ".git", "node_modules", ".venv", "venv"]
KEEP_HIDDEN = [".gitignore", ".env.example"]
_in = lambda names: ", ".join(f"'{n}'" for n in names)


@query(CTE + f"SELECT id, filename FROM cur WHERE NOT ((starts_with(filename, '.') AND filename NOT IN ({_in(KEEP_HIDDEN)})) OR filename IN ({_in(SKIP_FILES)}) OR list_has_any(string_split(original_path, '/'), [{_in(SKIP_FOLDERS)}]))")
def flt_skip(s, d):
    out = paths.hidden_or_system(F.col("filename"), F.col("original_path"), KEEP_HIDDEN, SKIP_FILES, SKIP_FOLDERS)
    return files(s, d).where(~out).select("id", "filename")


#: Names that say nothing; they are held against the lower-cased stem, so those with capitals never match.
_GENERIC = [
    r"^IMG_\d+", r"^DSC_\d+", r"^PXL_\d+", r"^DCIM_\d+", r"^\d{8}_\d{6}", r"^\d{4}-\d{2}-\d{2}", r"^Screenshot\s+\d{4}", r"^\d+$", r"^[a-f0-9]{32}",
    r"^unnamed\(\d+\)", r"^image\(\d+\)", r"^photo\(\d+\)", r"^file\(\d+\)", r"^\d{13}", r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}",
]
#: Names that a renaming gave, in whatever case.
_RENAMED = [r"^\d{8}_\d{6}(_\d+)?\.(jpg|jpeg|png|webp|gif|bmp|heic)$", r"^\d{8}_[A-Za-z_]+_\d{6}(_\d+)?\.(jpg|jpeg|png|webp|gif|bmp|heic)$", r"^Screenshot_.*\.(jpg|jpeg|png|webp|gif|bmp|heic)$"]


@query(CTE + r"SELECT id, filename FROM cur WHERE regexp_matches(regexp_replace(lower(filename), '^(.+)\.[^.]+$', '\1'), '" + "|".join(f"(?:{p})" for p in _GENERIC) + "')")
def flt_generic_name(s, d):
    return files(s, d).where(text.matches_any(paths.stem(F.lower("filename")), _GENERIC)).select("id", "filename")


@query(CTE + "SELECT id, filename FROM cur WHERE regexp_matches(filename, '(?i)" + "|".join(f"(?:{p})" for p in _RENAMED) + "')")
def flt_renamed(s, d):
    return files(s, d).where(F.col("filename").rlike("(?i)" + "|".join(f"(?:{p})" for p in _RENAMED))).select("id", "filename")


@query(CTE + "SELECT id, lower(file_extension) AS ext FROM cur WHERE lower(file_extension) ILIKE '.p%'")
def flt_glob(s, d):
    from ledgerloom.operators.catalog import glob_filter

    return glob_filter(files(s, d).select("id", F.lower("file_extension").alias("ext")), "ext", ".p*")


_CASCADE_SQL = "CASE WHEN regexp_matches(lower(filename), 'screenshot|bildschirmfoto|capture') THEN 'Screenshots' WHEN regexp_matches(lower(filename), 'sprite|tile|frame') THEN 'Sprites' WHEN lower(file_extension) IN ('.pdf', '.docx', '.txt') THEN 'Documents' WHEN starts_with(mime_type, 'image/') THEN 'Images' ELSE 'Other' END"


@query(CTE + f"SELECT id, {_CASCADE_SQL} AS class FROM cur")
def cls_type(s, d):
    """An ordered cascade as one column; rules are data."""
    return files(s, d).select("id", cascade().alias("class"))


def cascade() -> F.Column:
    low, ext = F.lower("filename"), F.lower("file_extension")
    rules = [
        (low.rlike("screenshot|bildschirmfoto|capture"), F.lit("Screenshots")),
        (low.rlike("sprite|tile|frame"), F.lit("Sprites")),
        (ext.isin(".pdf", ".docx", ".txt"), F.lit("Documents")),
        (F.col("mime_type").startswith("image/"), F.lit("Images")),
    ]
    return text.first_match(rules, F.lit("Other"))


_KEYWORDS = {"finance": ["invoice", "payslip", "price", "tax"], "archive": ["scanner", "archive", "records", "catalogue"], "people": ["clerk", "tenant", "supplier", "reviewer"]}


@query(
    "WITH s AS (SELECT doc_id, "
    + ", ".join("(" + " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::INT" for w in ws) + f") AS {k}" for k, ws in _KEYWORDS.items())
    + " FROM documents) SELECT doc_id, CASE WHEN greatest(finance, archive, people) = 0 THEN NULL WHEN finance >= archive AND finance >= people THEN 'finance' WHEN archive >= people THEN 'archive' ELSE 'people' END AS best FROM s"
)
def win_argmax_first(s, d):
    """cls_content: keyword occurrences per category; the first of the largest wins."""
    low = F.lower("text")
    scores = [F.struct(sum((text.count_of(low, w) for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(_KEYWORDS.items())]
    best = F.array_max(F.array(*scores))
    return table(s, d, "documents").select("doc_id", F.when(best["n"] > 0, best["k"]).alias("best"))


#: Legal forms behind the names of firms, the places where persons are named, and texts that tell who belongs to which firm.
_FIRM = r"\b([A-Z][A-Za-z0-9\s&\-\.]{2,50})\s+"
COMPANIES = [_FIRM + form for form in (r"LLC\b", r"L\.L\.C\.\b", r"Inc\.?\b", r"Incorporated\b", r"Corp\.?\b", r"Corporation\b", r"Company\b", r"Co\.\b", r"Ltd\.?\b", r"Limited\b", r"LLP\b", r"L\.L\.P\.\b")]
PEOPLE = [
    (r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\s+(?:Resume|CV|Cover Letter)\b", 2),
    (r"\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\s+(?:Portfolio|Biography|Bio)\b", 2),
    (r"\b(?:Name|Contact|From|To|Attn|Author|Client|Patient|Student):\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)\b", 1),
    (r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\s+<[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}>", 1),
    (r"\b(?:Prepared|Written|Submitted|Signed)\s+(?:by|for):\s+([A-Z][a-z]+\s+[A-Z][a-z]+)\b", 1),
    (r"\b([A-Z][a-z]+\s+[A-Z][a-z]+),?\s+(?:MD|PhD|Esq|DDS|CPA|MBA|JD|RN)\b", 1),
    (r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)\b", 1),
    (r"\b(?:Attendee|Participant|Speaker|Presenter):\s+([A-Z][a-z]+\s+[A-Z][a-z]+)\b", 1),
]
_WHO, _WHICH = r"([A-Z][a-z]+\s+[A-Z][a-z]+)", r"([A-Z][A-Za-z0-9\s&\-\.]{2,50}(?:\s+LLC|\s+Inc\.?|\s+Corp\.?|\s+Ltd\.?|\s+LLP))"
RELATIONS = [
    _WHO + r"\s+(?:at|from)\s+" + _WHICH,
    _WHO + r",?\s+(?:CEO|CFO|CTO|COO|President|Director|Manager|Founder)\s+(?:of|at)\s+" + _WHICH,
    _WHICH + r"\s*[-:]\s*(?:Contact|Representative):\s*" + _WHO,
    _WHO + r"\s+\(" + _WHICH + r"\)",
    _WHO + r"\s+<[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+)\.[a-zA-Z]{2,}>",
]
_MAIL_HOSTS = ["gmail", "yahoo", "hotmail", "outlook", "mail"]
_PLAIN_SQL = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_UNIQUE_SQL = "list_filter({0}, lambda x, i: length(x) > 2 AND list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


def _found_sql(parts: list[str]) -> str:
    return "(SELECT doc_id, list_transform(flatten([" + ", ".join(parts) + "]), lambda x: " + _PLAIN_SQL.format("x") + ") AS l FROM documents)"


_COMPANY_SQL = _found_sql([f"regexp_extract_all(text, '{p}', 1)" for p in COMPANIES])
_PEOPLE_SQL = _found_sql([f"regexp_extract_all(text, '{p}', 1)" if n == 1 else f"list_transform(list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2)), lambda z: z[1] || ' ' || z[2])" for p, n in PEOPLE])


def company_names(t: F.Column) -> F.Column:
    """Names before a legal form, pattern after pattern, each once in whatever case."""
    return text.unique_names(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in COMPANIES])))


def people_names(t: F.Column) -> F.Column:
    get = lambda p, i: F.regexp_extract_all(t, F.lit(p), F.lit(i))
    return text.unique_names(F.flatten(F.array(*[get(p, 1) if n == 1 else F.zip_with(get(p, 1), get(p, 2), lambda a, b: F.concat_ws(" ", a, b)) for p, n in PEOPLE])))


@query(f"SELECT doc_id, unnest({_UNIQUE_SQL.format('l')}) AS company FROM {_COMPANY_SQL}")
def fn_company_names(s, d):
    """Names with a legal form in texts, each once per document."""
    return table(s, d, "documents").select("doc_id", F.explode(company_names(F.col("text"))).alias("company"))


@query(f"SELECT doc_id, unnest({_UNIQUE_SQL.format('l')}) AS person FROM {_PEOPLE_SQL}")
def fn_people_names(s, d):
    """Names of persons in texts, each once per document."""
    return table(s, d, "documents").select("doc_id", F.explode(people_names(F.col("text"))).alias("person"))


@query(
    "WITH hits AS (SELECT doc_id, text, unnest(flatten([" + ", ".join(f"list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2))" for p in RELATIONS) + "])) AS h, generate_subscripts(flatten([" + ", ".join(f"list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2))" for p in RELATIONS) + "]), 1) AS n FROM documents),\n"
    + f"names AS (SELECT doc_id, n, contains(text, '@') AS mail, {_PLAIN_SQL.format('h[1]')} AS person, {_PLAIN_SQL.format('h[2]')} AS c, string_split({_PLAIN_SQL.format('h[2]')}, '.')[1] AS host FROM hits),\n"
    + f"firms AS (SELECT doc_id, n, person, CASE WHEN mail AND contains(c, '.') AND lower(host) NOT IN ({_in(_MAIL_HOSTS)}) THEN upper(host[1]) || lower(host[2:]) ELSE c END AS company FROM names)\n"
    + "SELECT doc_id, person, company FROM firms WHERE length(person) > 2 AND length(company) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, person ORDER BY n DESC) = 1"
)
def fn_person_company(s, d):
    """Who belongs to which firm; the last relation found of a person holds. In the third form the firm stands first, as in the lists that the results go into."""
    t = F.col("text")
    pairs = F.flatten(F.array(*[F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("b")) for p in RELATIONS]))
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    each = table(s, d, "documents").select("doc_id", F.contains(t, F.lit("@")).alias("mail"), F.posexplode(pairs).alias("n", "h")).select("doc_id", "n", "mail", plain(F.col("h")["a"]).alias("person"), plain(F.col("h")["b"]).alias("c"))
    host = F.split("c", r"\.")[0]
    named = each.withColumn("company", F.when(F.col("mail") & F.contains("c", F.lit(".")) & ~F.lower(host).isin(_MAIL_HOSTS), F.concat(F.upper(F.substring(host, 1, 1)), F.lower(F.substring(host, F.lit(2), F.length(host))))).otherwise(F.col("c")))
    return named.where("length(person) > 2 and length(company) > 2").groupBy("doc_id", "person").agg(F.max_by("company", "n").alias("company"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\w+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\d+$'))[:3], '_') AS words FROM documents".replace(r"'\w+'", "'[A-Za-z0-9_]+'"))
def fn_ocr_keywords(s, d):
    """The first three words of three or more characters that are no numbers."""
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
    return table(s, d, "documents").select("doc_id", F.array_join(F.slice(words, 1, 3), "_").alias("words"))
