"""Queries of linked-data documents: builders, serialisers, properties found out by other programs, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ids, jsonld
from ledgerloom.operators import validation
from ledgerloom.plans.catalog import CTE, files
from ledgerloom.plans.etl import LANGUAGE
from ledgerloom.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_U5 = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::INT & 3) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _u5(space, key: str) -> str:
    return _U5.format(h=f"sha1(unhex('{space.hex}') || encode({key}))")


def _got(source: DataFrame, key: str, /, **paths: str) -> DataFrame:
    """Fields of the JSON texts in ``j``."""
    return source.select(key, *[F.get_json_object("j", p).alias(n) for n, p in paths.items()])


_LANG_SQL = "CASE lower(file_extension) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE.items()) + " END"
_URL, _SIZE, _ISO = "'file://' || original_path", "CASE WHEN file_size > 0 THEN file_size || 'B' END", "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _files(s, d) -> DataFrame:
    languages = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    return files(s, d).withColumn("language", F.try_element_at(languages, F.lower("file_extension")))


def _documents(s, d, kind: str) -> DataFrame:
    of = kind if kind != "Archive" else "DigitalDocument"
    return _files(s, d).select("id", jsonld.document(of, ids.file_iri(F.col("original_path")), **jsonld.file_properties(kind)).alias("j"))


def _builder(name: str, kind: str, fields: dict[str, tuple[str, str]]) -> None:
    """A query of one builder: its documents' fields (path, SQL of the expected value)."""
    sql = CTE + "SELECT id, " + ", ".join(f"{e} AS {n}" for n, (_, e) in fields.items()) + f" FROM (SELECT *, {_LANG_SQL} AS language FROM cur)"
    query(sql, f"fn_jsonld_{name}")(lambda s, d: _got(_documents(s, d, kind), "id", **{n: p for n, (p, _) in fields.items()}))


_IRI = ("$.@id", "'urn:sha256:' || sha256(original_path)")
_NAME, _MIME, _CREATED = ("$.name", "filename"), ("$.encodingFormat", "mime_type"), ("$.dateCreated", _ISO.format("created_at"))
_builder("document", "DigitalDocument", {"iri": _IRI, "name": _NAME, "mime": _MIME, "url": ("$.url", _URL), "size": ("$.contentSize", _SIZE), "sha": ("$.identifier.value", "nullif(content_hash, '')"), "kind_of_id": ("$.identifier.propertyID", "CASE WHEN content_hash <> '' THEN 'sha256' END"), "created": _CREATED, "modified": ("$.dateModified", _ISO.format("modified_at"))})
_builder("image", "ImageObject", {"type": ("$.@type", "'ImageObject'"), "name": _NAME, "mime": _MIME, "url": ("$.contentUrl", _URL), "width": ("$.width", "image_width::VARCHAR"), "height": ("$.height", "image_height::VARCHAR"), "created": _CREATED})
_builder("video", "VideoObject", {"name": _NAME, "url": ("$.contentUrl", _URL), "uploaded": ("$.uploadDate", _ISO.format("created_at")), "seen": ("$.interactionStatistic.userInteractionCount", "'0'"), "action": ("$.interactionStatistic.interactionType", "'https://schema.org/WatchAction'")})
_builder("audio", "AudioObject", {"name": _NAME, "url": ("$.contentUrl", _URL), "mime": _MIME, "album": ("$.inAlbum.name", "nullif(session_id, '')"), "album_type": ("$.inAlbum.@type", "CASE WHEN session_id <> '' THEN 'MusicAlbum' END")})
_builder("code", "SoftwareSourceCode", {"name": _NAME, "language": ("$.programmingLanguage", "language"), "repository": ("$.codeRepository", _URL)})
_builder("dataset", "Dataset", {"name": _NAME, "description": ("$.description", "'Data of ' || filename"), "part_type": ("$.distribution[0].@type", "'DataDownload'"), "part_mime": ("$.distribution[0].encodingFormat", "mime_type"), "part_size": ("$.distribution[0].contentSize", _SIZE)})
_builder("archive", "Archive", {"type": ("$.@type", "'DigitalDocument'"), "additional": ("$.additionalType", "'Archive'"), "name": _NAME, "size": ("$.contentSize", _SIZE)})

_NORM = r"regexp_replace(lower(name), '^\s+|\s+$', '', 'g')"


@query(
    f"SELECT id, 'urn:uuid:' || {_u5(ids.NAMESPACES['company'], _NORM)} AS iri, name, normalized_name AS legal, CASE WHEN domain <> '' THEN 'https://' || domain END AS url, CASE WHEN domain <> '' THEN 'info@' || domain END AS contact, strftime(first_seen, '%Y-%m-%d') AS founded FROM companies WHERE name IS NOT NULL"
)
def fn_jsonld_organization(s, d):
    c = table(s, d, "companies").where("name is not null")
    j = jsonld.organization(jsonld.entity_iri("company", F.col("name")), F.col("name"), F.col("normalized_name"), F.col("domain"), F.col("first_seen"))
    return _got(c.select("id", j.alias("j")), "id", iri="$.@id", name="$.name", legal="$.legalName", url="$.url", contact="$.contactPoint[0].email", founded="$.foundingDate")


@query(
    f"SELECT id, 'urn:uuid:' || {_u5(ids.NAMESPACES['person'], _NORM)} AS iri, CASE WHEN len(w) > 1 THEN w[1] END AS given, CASE WHEN len(w) > 1 THEN w[-1] END AS family, nullif(trim(email), '') AS email, nullif(trim(role), '') AS job FROM (SELECT *, regexp_split_to_array(trim(name), '\\s+') AS w FROM people WHERE name IS NOT NULL)"
)
def fn_jsonld_person(s, d):
    p = table(s, d, "people").where("name is not null")
    j = jsonld.human(jsonld.entity_iri("person", F.col("name")), F.col("name"), F.col("email"), F.col("role"), F.lit(None).cast("string"))
    return _got(p.select("id", j.alias("j")), "id", iri="$.@id", given="$.givenName", family="$.familyName", email="$.email", job="$.jobTitle")


_KIND_SQL = "CASE WHEN starts_with(mime_type, 'image/') THEN 'ImageObject' WHEN starts_with(mime_type, 'video/') THEN 'VideoObject' WHEN starts_with(mime_type, 'audio/') THEN 'AudioObject' WHEN language IS NOT NULL THEN 'SoftwareSourceCode' WHEN mime_type IN ('application/zip', 'application/x-tar', 'application/gzip') THEN 'Archive' WHEN mime_type IN ('text/csv', 'application/json') THEN 'Dataset' ELSE 'DigitalDocument' END"


def _dispatched(s, d) -> DataFrame:
    """id, kind and the document that the builder of its kind gives, each kind's builder evaluated only for its rows."""
    m = F.col("mime_type")
    kind = (
        F.when(m.startswith("image/"), "ImageObject").when(m.startswith("video/"), "VideoObject").when(m.startswith("audio/"), "AudioObject").when(F.col("language").isNotNull(), "SoftwareSourceCode")
        .when(m.isin("application/zip", "application/x-tar", "application/gzip"), "Archive").when(m.isin("text/csv", "application/json"), "Dataset").otherwise("DigitalDocument")
    )
    j = None
    for k in list(jsonld.REQUIRED)[:7]:
        made = jsonld.document("DigitalDocument" if k == "Archive" else k, ids.file_iri(F.col("original_path")), **jsonld.file_properties(k))
        j = F.when(F.col("kind") == k, made) if j is None else j.when(F.col("kind") == k, made)
    return _files(s, d).withColumn("kind", kind).withColumn("j", j)


@query(CTE + f"SELECT id, kind, CASE WHEN kind = 'Archive' THEN 'DigitalDocument' ELSE kind END AS type, CASE WHEN kind IN ('ImageObject', 'VideoObject', 'AudioObject') THEN {_URL} END AS content_url, CASE WHEN kind = 'Archive' THEN 'Archive' END AS additional FROM (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, {_LANG_SQL} AS language FROM cur))")
def fn_schema_dispatch(s, d):
    """Each file through the builder of its kind."""
    return _dispatched(s, d).select("id", "kind", F.get_json_object("j", "$.@type").alias("type"), F.get_json_object("j", "$.contentUrl").alias("content_url"), F.get_json_object("j", "$.additionalType").alias("additional"))


@query(
    CTE
    + f"SELECT id, 'urn:sha256:' || sha256(original_path) AS iri, filename AS name, CASE WHEN status = 'organized' THEN 'kept of ' || id END AS abstract, CASE WHEN status = 'organized' THEN '7' END AS pages, CASE WHEN kind = 'DigitalDocument' THEN {_SIZE} END AS size FROM (SELECT *, {_KIND_SQL} AS kind FROM (SELECT *, {_LANG_SQL} AS language FROM cur)) WHERE kind <> 'Archive'"
)
def fn_schema_regen(s, d):
    """Documents built anew, with the properties that only the old ones have (abstract, pages) taken over as the JSON that they were."""
    rows = _dispatched(s, d).where("kind <> 'Archive'")
    old = F.when(F.col("status") == "organized", F.to_json(F.struct(F.lit("stale").alias("name"), F.concat(F.lit("kept of "), "id").alias("abstract"), F.lit(7).alias("numberOfPages"))))
    new = jsonld.regenerated(F.col("j"), old, ["abstract", "numberOfPages", "keywords", "author", "about"])
    size = F.when(F.col("kind") == "DigitalDocument", F.get_json_object("n", "$.contentSize"))
    return rows.select("id", "kind", new.alias("n")).select("id", F.get_json_object("n", "$.@id").alias("iri"), F.get_json_object("n", "$.name").alias("name"), F.get_json_object("n", "$.abstract").alias("abstract"), F.get_json_object("n", "$.numberOfPages").alias("pages"), size.alias("size"))


@query(CTE + "SELECT id, round(least(((filename IS NOT NULL)::INT + (mime_type IS NOT NULL)::INT + 0.5 * ((created_at IS NOT NULL)::INT + (modified_at IS NOT NULL)::INT + (file_size > 0 IS TRUE)::INT + (original_path IS NOT NULL)::INT)) / 2, 1), 6) AS score, concat_ws(',', CASE WHEN filename IS NULL THEN 'name' END, CASE WHEN mime_type IS NULL THEN 'encodingFormat' END) AS missing FROM cur")
def fn_required_tables(s, d):
    """Required and recommended properties of a kind against the keys of its documents."""
    score, lacking = jsonld.completeness(F.col("j"), "DigitalDocument")
    return _documents(s, d, "DigitalDocument").select("id", F.round(score, 6).alias("score"), F.array_join(lacking, ",").alias("missing"))


def _nested(s, d) -> DataFrame:
    j = jsonld.document("DigitalDocument", F.concat(F.lit("urn:x:"), "id"), name=F.col("filename"), url=F.concat(F.lit("file://"), "original_path"), author=jsonld.given(F.col("session_id"), F.struct(F.lit("Person").alias("@type"), F.col("session_id").alias("name"))), keywords=F.array(F.lit("a&b"), F.col("schema_type")))
    return files(s, d).where("filename is not null and schema_type is not null").select("id", "filename", j.alias("j"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_NESTED_SQL = CTE + "SELECT id, {} AS html FROM cur WHERE filename IS NOT NULL AND schema_type IS NOT NULL"
_MICRO = (
    "'<div itemscope itemtype=\"https://schema.org/DigitalDocument\">' || chr(10) || '  <meta itemprop=\"name\" content=\"' || " + _ESC.format("filename") + " || '\">' || chr(10) || '  <link itemprop=\"url\" href=\"file://' || " + _ESC.format("original_path") + " || '\">' || chr(10)"
    " || CASE WHEN session_id <> '' THEN '<div itemscope itemtype=\"https://schema.org/Person\">' || chr(10) || '  <meta itemprop=\"name\" content=\"' || " + _ESC.format("session_id") + " || '\">' || chr(10) || '</div>' || chr(10) ELSE '' END"
    " || '  <meta itemprop=\"keywords\" content=\"a&amp;b\">' || chr(10) || '  <meta itemprop=\"keywords\" content=\"' || schema_type || '\">' || chr(10) || '</div>'"
)
_RDFA = (
    "'<div vocab=\"https://schema.org/\" typeof=\"DigitalDocument\">' || chr(10) || '  <meta property=\"name\" content=\"' || " + _ESC.format("filename") + " || '\">' || chr(10) || '  <link property=\"url\" href=\"file://' || " + _ESC.format("original_path") + " || '\">' || chr(10)"
    " || CASE WHEN session_id <> '' THEN '  <div property=\"author\">' || chr(10) || '    <div vocab=\"https://schema.org/\" typeof=\"Person\">' || chr(10) || '  <meta property=\"name\" content=\"' || " + _ESC.format("session_id") + " || '\">' || chr(10) || '</div>' || chr(10) || '  </div>' || chr(10) ELSE '' END"
    " || '  <meta property=\"keywords\" content=\"a&amp;b\">' || chr(10) || '  <meta property=\"keywords\" content=\"' || schema_type || '\">' || chr(10) || '</div>'"
)


@query(_NESTED_SQL.format(_MICRO))
def fn_to_microdata_nested(s, d):
    return _nested(s, d).select("id", jsonld.microdata(F.col("j")).alias("html"))


@query(_NESTED_SQL.format(_RDFA))
def fn_to_rdfa(s, d):
    return _nested(s, d).select("id", jsonld.rdfa(F.col("j")).alias("html"))


@query("SELECT id, '<script type=\"application/ld+json\">' || chr(10) || '{\"@context\":\"https://schema.org\",\"@type\":\"Thing\",\"@id\":\"urn:c:' || id || '\",\"level\":' || level || '}' || chr(10) || '</script>' AS script FROM categories WHERE level IS NOT NULL")
def fn_to_script(s, d):
    """fn_to_jsonld in a script tag."""
    c = table(s, d, "categories").where("level is not null")
    return c.select("id", jsonld.script(jsonld.document("Thing", F.concat(F.lit("urn:c:"), F.col("id").cast("string")), level=F.col("level"))).alias("script"))


@query("SELECT level, count(*) AS documents, CASE WHEN count(*) = 1 THEN 'bare' ELSE 'graph' END AS shape FROM categories WHERE level IS NOT NULL GROUP BY 1")
def fn_to_graph(s, d):
    """Documents of each level of the fixed category table in one @graph, a lone one bare."""
    c = table(s, d, "categories").where("level is not null").select("level", F.to_json(F.struct("id")).alias("j"))
    g = c.groupBy("level").agg(jsonld.graph(F.collect_list("j")).alias("j"))
    n = F.json_array_length(F.get_json_object("j", "$.@graph"))
    return g.select("level", F.coalesce(n, F.lit(1)).cast("bigint").alias("documents"), F.when(n.isNull(), "bare").otherwise("graph").alias("shape"))


@query("SELECT id, '<title>' || " + _ESC.format("name") + " || '</title>' AS title, contains(name, '&') AS escaped FROM categories")
def fn_html_page(s, d):
    p = jsonld.page(F.col("name"), F.lit("<p></p>"), jsonld.script(F.lit("{}")))
    return table(s, d, "categories").select("id", "name", p.alias("p")).select("id", F.regexp_extract("p", "(<title>.*</title>)", 1).alias("title"), F.contains("name", F.lit("&")).alias("escaped"))


def _enriched(source: DataFrame, key: str, properties: dict, /, **paths: str) -> DataFrame:
    return _got(source.select(key, F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()])).alias("j")), key, **paths)


def _map(**cols) -> F.Column:
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))])


@query(CTE + f"SELECT id, {_IRI[1]} AS iri, filename AS name, {_URL} AS url, coalesce(mime_type, 'application/octet-stream') AS mime, file_size::VARCHAR AS size, {_ISO.format('created_at')} AS created FROM cur")
def fn_enrich_file_stats(s, d):
    c = F.col
    own = {"@id": ids.file_iri(c("original_path")), "name": c("filename"), "url": F.concat(F.lit("file://"), "original_path"), "encodingFormat": F.coalesce("mime_type", F.lit("application/octet-stream")), "contentSize": c("file_size"), "dateCreated": jsonld.iso(c("created_at"))}
    return _enriched(files(s, d), "id", own, iri="$.@id", name="$.name", url="$.url", mime="$.encodingFormat", size="$.contentSize", created="$.dateCreated")


@query(CTE + f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, image_width::VARCHAR AS width, CASE WHEN image_width IS NOT NULL THEN 'Cam' || CASE WHEN has_faces IS NOT NULL THEN ' ' || (has_faces::VARCHAR) ELSE '' END END AS camera, CASE WHEN session_id <> '' THEN 'urn:uuid:' || {_u5(ids.NAMESPACES['person'], r'''regexp_replace(lower(session_id), '^\s+|\s+$', '', 'g')''')} END AS creator FROM cur")
def fn_enrich_exif(s, d):
    m = _map(DateTime=F.date_format("created_at", "yyyy:MM:dd HH:mm:ss"), ImageWidth=F.col("image_width"), Make=F.when(F.col("image_width").isNotNull(), "Cam"), Model=F.when(F.col("image_width").isNotNull(), F.col("has_faces").cast("string")), Artist=F.col("session_id"))
    return _enriched(files(s, d), "id", jsonld.from_exif(m), created="$.dateCreated", width="$.width", camera="$.exifData.value", creator="$.creator.@id")


@query("SELECT doc_id, substr(text, 1, 20) AS name, lang AS language, CASE WHEN source <> '' THEN source END AS author FROM documents WHERE text <> ''")
def fn_enrich_document(s, d):
    m = _map(title=F.substring("text", 1, 20), language=F.col("lang"), creator=F.col("source"))
    return _enriched(table(s, d, "documents").where("text <> ''"), "doc_id", jsonld.from_document(m), name="$.name", language="$.inLanguage", author="$.author.name")


@query("SELECT id, 'PT' || CASE WHEN t // 3600 > 0 THEN (t // 3600) || 'H' ELSE '' END || CASE WHEN t % 3600 // 60 > 0 THEN (t % 3600 // 60) || 'M' ELSE '' END || CASE WHEN t % 60 > 0 THEN (t % 60) || 'S' ELSE '' END AS duration, '2020-01-01' AS published, '3' AS position, '128kbps' AS bitrate, 'urn:uuid:' || " + _u5(ids.ALBUM, "lower(trim(base_path))") + " AS album FROM (SELECT DISTINCT id, base_path, floor(total_processing_time_sec)::BIGINT AS t FROM organization_sessions WHERE total_processing_time_sec >= 1 AND trim(base_path) <> '')")
def fn_enrich_audio(s, d):
    m = _map(title=F.col("id"), album=F.col("base_path"), year=F.lit("2020"), track_number=F.lit("3"), bitrate=F.lit("128"))
    t = table(s, d, "organization_sessions").where("total_processing_time_sec >= 1 and trim(base_path) <> ''")
    return _enriched(t, "id", jsonld.from_audio(m, F.col("total_processing_time_sec")), duration="$.duration", published="$.datePublished", position="$.position", bitrate="$.bitrate", album="$.inAlbum.@id").distinct()


@query(CTE + "SELECT id, image_width::VARCHAR AS width, 'h264' AS codec, coalesce(strftime(organized_at, '%Y-%m-%d'), '2026-07-01') AS uploaded FROM cur WHERE image_width IS NOT NULL")
def fn_enrich_video(s, d):
    m = _map(width=F.col("image_width"), codec=F.lit("h264"), upload_date=F.date_format("organized_at", "yyyy-MM-dd"))
    return _enriched(files(s, d).where("image_width is not null"), "id", jsonld.from_video(m, F.lit(None).cast("double"), F.lit("2026-07-01")), width="$.width", codec="$.videoCodec", uploaded="$.uploadDate")


@query(CTE + f"SELECT id, language, 'Contains ' || length(filename) || ' functions' AS description, 'pandas' AS used, '2.2' AS version, '' AS second_version FROM (SELECT *, {_LANG_SQL} AS language FROM cur) WHERE language IS NOT NULL AND filename IS NOT NULL")
def fn_enrich_code(s, d):
    m = _map(language=F.col("language"))
    made = jsonld.from_code(m, F.array(F.lit("pandas==2.2"), F.lit("numpy")), F.length("filename"))
    return _enriched(_files(s, d).where("language is not null and filename is not null"), "id", made, language="$.programmingLanguage", description="$.description", used="$.dependencies[0].name", version="$.dependencies[0].softwareVersion", second_version="$.dependencies[1].softwareVersion")


@query("SELECT id, coalesce(strftime(started_at, '%Y'), '') || '/' || coalesce(strftime(completed_at, '%Y'), '') AS span, total_files::VARCHAR AS rows, 'x' AS first FROM (SELECT DISTINCT id, started_at, completed_at, total_files FROM organization_sessions WHERE started_at IS NOT NULL)")
def fn_enrich_dataset(s, d):
    m = _map(start=F.date_format("started_at", "yyyy"), end=F.date_format("completed_at", "yyyy"))
    t = table(s, d, "organization_sessions").where("started_at is not null").select("id", "started_at", "completed_at", "total_files").distinct()
    return _enriched(t, "id", jsonld.from_dataset(m, F.array(F.lit("x"), F.lit("y")), F.col("total_files")), span="$.temporalCoverage", rows="$.additionalProperty[0].value", first="$.variableMeasured[0].name")


_LABELS = ["PERSON", "org", "GPE", "gadget"]


@query(
    "SELECT id, CASE id % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Place' ELSE 'Thing' END AS kind, 'urn:uuid:' || CASE id % 4 WHEN 0 THEN "
    + _u5(ids.NAMESPACES["person"], _NORM) + " WHEN 1 THEN " + _u5(ids.NAMESPACES["company"], _NORM) + " WHEN 2 THEN " + _u5(ids.NAMESPACES["location"], _NORM) + " ELSE " + _u5(ids.THING, _NORM)
    + " END AS iri, name || ', x' AS keywords FROM categories"
)
def fn_enrich_nlp(s, d):
    """fn_entity_type_map and fn_entity_uuid in mentions of named entities."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("id") % 4 + 1).cast("int"))
    made = jsonld.from_language(F.array("name", F.lit("x")), F.array("name"), F.array(F.struct(label.alias("label"), F.col("name").alias("name"))), F.lit("en"), F.lit(None).cast("string"))
    return _enriched(table(s, d, "categories"), "id", made, kind="$.mentions[0].@type", iri="$.mentions[0].@id", keywords="$.keywords")


@query(CTE + "SELECT id, coalesce(current_path, filename) AS name, image_width::VARCHAR AS width, coalesce(mime_type, 'application/octet-stream') AS mime FROM cur")
def fn_enriched_schema(s, d):
    """Several sources of properties in one document: later ones hold unless null."""
    c = F.col
    stats = {"name": c("filename"), "encodingFormat": F.coalesce("mime_type", F.lit("application/octet-stream"))}
    made = jsonld.enriched(stats, {"width": c("image_width")}, {"name": c("current_path"), "encodingFormat": F.lit(None).cast("string")})
    return _enriched(files(s, d), "id", made, name="$.name", width="$.width", mime="$.encodingFormat")


@query("SELECT id, 'a, ' || name AS keywords, 'urn:uuid:' || canonical_id AS iri, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS made, parent_id::VARCHAR AS part_of FROM categories WHERE canonical_id IS NOT NULL")
def fn_base_setters(s, d):
    """Ids as IRIs, keywords joined, dates as ISO texts, relations as nodes, contexts merged."""
    c = F.col
    rel = jsonld.given(c("parent_id"), jsonld.node("Thing", identifier=c("parent_id")))
    j = jsonld.document("Thing", ids.to_iri(c("canonical_id")), keywords=F.array_join(F.array(F.lit("a"), "name"), ", "), dateCreated=jsonld.iso(c("created_at")), isPartOf=rel)
    return _got(table(s, d, "categories").where("canonical_id is not null").select("id", j.alias("j")), "id", keywords="$.keywords", iri="$.@id", made="$.dateCreated", part_of="$.isPartOf.identifier")


@query(CTE + "SELECT coalesce(kind, 'none') AS kind, count(*) AS documents, min(id) AS first FROM (SELECT id, schema_type AS kind FROM cur WHERE status = 'organized' UNION SELECT id, schema_type FROM cur WHERE image_width IS NOT NULL) GROUP BY 1")
def reg_collection(s, d):
    """Two collections of documents in one; a document in both counts once."""
    f = files(s, d).select("id", "status", "image_width", F.coalesce("schema_type", F.lit("none")).alias("kind"))
    one, other = f.where("status = 'organized'").select("id", "kind"), f.where("image_width is not null").select("id", "kind")
    return one.unionByName(other).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    """Documents with faults of all kinds."""
    c = F.col
    j = F.to_json(
        F.struct(
            F.when(c("status").isNotNull(), F.lit(jsonld.CONTEXT)).alias("@context"), c("schema_type").alias("@type"), c("filename").alias("name"), c("current_path").alias("contentUrl"), F.concat(F.lit("https://files.test/"), "id").alias("url"),
            c("image_width").alias("width"), c("image_height").cast("string").alias("height"), F.date_format("created_at", "yyyy-MM-dd").alias("dateCreated"), F.date_format("modified_at", "dd.MM.yyyy").alias("dateModified"),
            F.when(c("has_faces"), "PT5M").when(~c("has_faces"), "soon").alias("duration"), c("mime_type").alias("encodingFormat"), F.when(c("session_id").isNotNull(), F.struct(F.lit("Person").alias("@type"), F.lit("x").alias("name"))).alias("author"),
        )
    )
    return files(s, d).select("id", j.alias("j"))


_HAS = {"name": "filename IS NOT NULL", "contentUrl": "current_path IS NOT NULL", "author": "session_id IS NOT NULL", "encodingFormat": "mime_type IS NOT NULL", "duration": "has_faces IS NOT NULL"}
_RULES = ", ".join(f"('{k}', {i}, '{p}')" for k, both in validation.KINDS.items() for i, names in enumerate(both) for p in names)
_HAS_SQL = "CASE prop " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in _HAS.items()) + " ELSE false END"
_KNOWN = ", ".join(f"'{k}'" for k in validation.KINDS)
_MESSAGES = (
    CTE
    + f", rules AS (SELECT * FROM (VALUES {_RULES}) t(kind, role, prop)), m AS ("
    + "SELECT id, 'error' AS level, 'context' AS message, '@context' AS property FROM cur WHERE status IS NULL"
    + " UNION ALL SELECT id, 'error', 'type', '@type' FROM cur WHERE schema_type IS NULL"
    + f" UNION ALL SELECT id, 'success', 'type', NULL FROM cur WHERE schema_type IN ({_KNOWN})"
    + f" UNION ALL SELECT id, 'warning', 'unknown type', '@type' FROM cur WHERE schema_type NOT IN ({_KNOWN})"
    + f" UNION ALL SELECT id, 'error', 'missing', prop FROM cur JOIN rules ON kind = schema_type AND role = 0 WHERE NOT {_HAS_SQL}"
    + " UNION ALL SELECT id, 'error', 'empty', prop FROM cur JOIN rules ON kind = schema_type AND role = 0 WHERE (prop = 'name' AND filename = '') OR (prop = 'contentUrl' AND current_path = '')"
    + " UNION ALL SELECT id, 'error', 'value type', 'height' FROM cur WHERE image_height IS NOT NULL"
    + " UNION ALL SELECT id, 'error', 'url', 'contentUrl' FROM cur WHERE current_path IS NOT NULL"
    + " UNION ALL SELECT id, 'warning', 'date', 'dateModified' FROM cur WHERE modified_at IS NOT NULL"
    + " UNION ALL SELECT id, 'warning', 'duration', 'duration' FROM cur WHERE NOT has_faces"
    + " UNION ALL SELECT id, 'warning', 'nested', 'author' FROM cur WHERE session_id IS NOT NULL"
    + f" UNION ALL SELECT id, 'info', 'recommended', string_agg(prop, ', ' ORDER BY n) FROM (SELECT id, prop, n FROM cur JOIN (SELECT *, row_number() OVER () AS n FROM rules) ON kind = schema_type AND role = 1 WHERE NOT {_HAS_SQL}) GROUP BY id"
    + " UNION ALL SELECT id, 'error', 'rich results', 'contentUrl' FROM cur WHERE schema_type = 'ImageObject' AND current_path IS NULL"
    + " UNION ALL SELECT id, 'error', 'rich results', p FROM cur, (VALUES ('name'), ('description'), ('thumbnailUrl'), ('uploadDate')) v(p) WHERE schema_type = 'VideoObject' AND NOT (p = 'name' AND filename IS NOT NULL))\n"
)


def _groups(name: str, messages: list[str], text: str) -> None:
    names = ", ".join(f"'{m}'" for m in messages)

    def run(s, d):
        got = _checked(s, d).select(F.explode(validation.document_messages(F.col("j"))).alias("m")).select("m.*").where(F.col("message").isin(messages))
        return got.groupBy("level", "message", "property").agg(F.count(F.lit(1)).alias("n"))

    run.__doc__ = text
    query(_MESSAGES + f"SELECT level, message, property, count(*) AS n FROM m WHERE message IN ({names}) GROUP BY 1, 2, 3", name)(run)


_groups("val_structure", ["context", "type", "unknown type"], "Context and type of documents.")
_groups("val_required_properties", ["missing", "empty", "recommended"], "Properties that the kind must and should have.")
_groups("val_property_types", ["value type"], "Kinds of values.")
_groups("val_formats", ["url", "date", "duration"], "Addresses, dates and durations.")
_groups("val_nested", ["nested"], "Nodes within documents that have errors of their own.")
_groups("val_rich_documents", ["rich results"], "What search engines want of some kinds.")


@query(_MESSAGES + ", n AS (SELECT id, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings, count(*) FILTER (WHERE level = 'info') AS infos FROM m GROUP BY 1) SELECT id, errors::INT AS errors, warnings::INT AS warnings, infos::INT AS infos, errors = 0 AS is_valid FROM n")
def val_documents(s, d):
    """A report for each document."""
    return validation.report(_checked(s, d), F.col("j")).select("id", "errors", "warnings", "infos", "is_valid")
