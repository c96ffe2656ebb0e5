"""Linked-data documents as columns: nodes, one builder per kind of thing, serialisers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import ids

CONTEXT = "https://schema.org"
#: The properties that each kind must and should have.
REQUIRED = {
    "DigitalDocument": ["name", "encodingFormat"],
    "ImageObject": ["contentUrl", "encodingFormat"],
    "VideoObject": ["name", "contentUrl", "uploadDate"],
    "AudioObject": ["name", "contentUrl"],
    "SoftwareSourceCode": ["name", "programmingLanguage"],
    "Dataset": ["name", "description"],
    "Archive": ["name", "encodingFormat"],
    "Organization": ["name"],
    "Person": ["name"],
}
RECOMMENDED = {
    "DigitalDocument": ["author", "dateCreated", "dateModified", "keywords", "abstract", "inLanguage", "contentSize", "url"],
    "ImageObject": ["name", "description", "width", "height", "caption", "creator", "dateCreated", "exifData", "contentLocation"],
    "VideoObject": ["description", "thumbnailUrl", "duration", "width", "height", "encodingFormat", "creator", "datePublished"],
    "AudioObject": ["description", "duration", "encodingFormat", "creator", "datePublished", "inLanguage"],
    "SoftwareSourceCode": ["description", "author", "dateCreated", "dateModified", "codeRepository", "license", "runtimePlatform"],
    "Dataset": ["creator", "datePublished", "distribution", "keywords", "license", "spatial", "temporal", "variableMeasured"],
    "Archive": ["description", "hasPart", "dateCreated", "contentSize"],
    "Organization": ["description", "url", "logo", "email", "telephone", "address", "legalName", "foundingDate", "founder", "numberOfEmployees", "areaServed", "sameAs"],
    "Person": ["givenName", "familyName", "email", "telephone", "jobTitle", "worksFor", "address", "image", "url", "sameAs", "birthDate", "nationality"],
}
#: Kinds of named entities.
ENTITY_KINDS = {"PERSON": "Person", "ORG": "Organization", "ORGANIZATION": "Organization", "GPE": "Place", "LOC": "Place", "LOCATION": "Place", "EVENT": "Event", "WORK_OF_ART": "CreativeWork", "PRODUCT": "Product", "DATE": "Date", "TIME": "Time"}


def node(kind: Column | str, iri: Column | None = None, **properties: Column) -> Column:
    """A struct with its type, its id if there is one, and its properties; ``to_json`` leaves nulls out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("@type"), *([] if iri is None else [iri.alias("@id")]), *[c.alias(n) for n, c in properties.items()])


def given(value: Column, made: Column) -> Column:
    """``made`` where there is a value."""
    return F.when(value.isNotNull() & (value.cast("string") != ""), made)


def entity_iri(kind: str, name: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), ids.uuid5(ids.NAMESPACES[kind], ids.normalized(name)))


def person(name: Column) -> Column:
    return given(name, node("Person", entity_iri("person", name), name=name))


def identifier(value: Column, kind: str) -> Column:
    return given(value, node("PropertyValue", propertyID=F.lit(kind), value=value))


def place(name: Column, lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), node("Place", name=name, geo=node("GeoCoordinates", latitude=lat, longitude=lon)))


def size_text(size: Column) -> Column:
    return F.when(size > 0, F.concat(size.cast("string"), F.lit("B")))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def document(kind: Column | str, iri: Column, **properties: Column) -> Column:
    """The JSON text of a whole document."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), kind.alias("@type"), iri.alias("@id"), *[c.alias(n) for n, c in properties.items()]))


def file_properties(kind: str) -> dict[str, Column]:
    """What a row of the file catalog gives a document of its kind; the columns are those of the catalog."""
    c = F.col
    name, url, mime = c("filename"), F.concat(F.lit("file://"), c("original_path")), c("mime_type")
    made, changed = iso(c("created_at")), iso(c("modified_at"))
    common = {"name": name, "encodingFormat": mime}
    if kind == "DigitalDocument":
        return common | {"url": url, "contentSize": size_text(c("file_size")), "identifier": identifier(c("content_hash"), "sha256"), "dateCreated": made, "dateModified": changed}
    if kind == "ImageObject":
        return common | {"contentUrl": url, "width": c("image_width"), "height": c("image_height"), "contentSize": size_text(c("file_size")), "dateCreated": made}
    if kind == "VideoObject":
        return common | {"contentUrl": url, "uploadDate": made, "width": c("image_width"), "height": c("image_height"), "interactionStatistic": node("InteractionCounter", interactionType=F.lit(f"{CONTEXT}/WatchAction"), userInteractionCount=F.lit(0))}
    if kind == "AudioObject":
        return common | {"contentUrl": url, "inAlbum": given(c("session_id"), node("MusicAlbum", name=c("session_id")))}
    if kind == "SoftwareSourceCode":
        return {"name": name, "programmingLanguage": c("language"), "codeRepository": url, "dateCreated": made, "dateModified": changed}
    if kind == "Dataset":
        return {"name": name, "description": F.concat(F.lit("Data of "), name), "url": url, "distribution": F.array(node("DataDownload", contentUrl=url, encodingFormat=mime, contentSize=size_text(c("file_size"))))}
    if kind == "Archive":
        return common | {"additionalType": F.lit("Archive"), "contentSize": size_text(c("file_size")), "dateCreated": made}
    raise ValueError(kind)


def organization(iri: Column, name: Column, legal: Column, domain: Column, founded: Column) -> Column:
    return document("Organization", iri, name=name, legalName=legal, url=given(domain, F.concat(F.lit("https://"), domain)), foundingDate=F.date_format(founded, "yyyy-MM-dd"), contactPoint=given(domain, F.array(node("ContactPoint", contactType=F.lit("general"), email=F.concat(F.lit("info@"), domain)))))


def human(iri: Column, name: Column, email: Column, role: Column, firm: Column) -> Column:
    words = F.split(F.trim(name), r"\s+")
    return document("Person", iri, name=name, givenName=F.when(F.size(words) > 1, words[0]), familyName=F.when(F.size(words) > 1, F.element_at(words, -1)), email=F.nullif(F.trim(email), F.lit("")), jobTitle=F.nullif(F.trim(role), F.lit("")), worksFor=given(firm, node("Organization", name=firm)))


def completeness(doc: Column, kind: str) -> tuple[Column, Column]:
    """The share of required properties that a JSON text has (recommended ones count half), and those it lacks."""
    from ledgerloom.functions import text

    keys = F.json_object_keys(doc)
    return text.completeness(keys, REQUIRED[kind], RECOMMENDED[kind]), text.missing(keys, REQUIRED[kind])


def regenerated(new: Column, old: Column, keep: list[str]) -> Column:
    """``new`` with the properties ``keep`` of ``old`` that it has; both are JSON texts. Values stay the JSON that they were."""
    strings = "map<string,variant>"
    a, b = F.from_json(new, strings), F.coalesce(F.from_json(old, strings), F.from_json(F.lit("{}"), strings))
    kept = F.map_filter(b, lambda k, v: k.isin(keep))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(kept), k)), kept))


def graph(documents: Column) -> Column:
    """An array of JSON texts as one: a lone one stays bare."""
    return F.when(F.size(documents) == 1, documents[0]).otherwise(F.concat(F.lit('{"@graph":['), F.array_join(documents, ","), F.lit("]}")))


def script(doc: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">\n'), doc, F.lit("\n</script>"))


LINKS = ("url", "contentUrl", "thumbnailUrl")
PICTURES = ("image", "logo")


def _text(v) -> str:
    return escape(str(v))


def _values(doc: dict) -> Iterator[tuple[str, object, bool]]:
    """Property, value and whether it is a node, lists taken apart."""
    for key, value in doc.items():
        if not key.startswith("@"):
            for v in value if isinstance(value, list) else [value]:
                yield key, v, isinstance(v, dict) and "@type" in v


def microdata_of(doc: dict) -> str:
    lines = [f'<div itemscope itemtype="{CONTEXT}/{doc.get("@type", "Thing")}">']
    for key, v, nested in _values(doc):
        single = not isinstance(doc[key], list)
        if nested:
            lines.append(microdata_of(v))
        elif single and key in PICTURES:
            if isinstance(v, str):
                lines.append(f'  <link itemprop="{key}" href="{_text(v)}">')
        elif single and key in LINKS:
            lines.append(f'  <link itemprop="{key}" href="{_text(v)}">')
        else:
            lines.append(f'  <meta itemprop="{key}" content="{_text(v)}">')
    return "\n".join([*lines, "</div>"])


def rdfa_of(doc: dict) -> str:
    lines = [f'<div vocab="{CONTEXT}/" typeof="{doc.get("@type", "Thing")}">']
    for key, v, nested in _values(doc):
        if nested:
            lines += [f'  <div property="{key}">', f"    {rdfa_of(v)}", "  </div>"]
        elif key in LINKS and not isinstance(doc[key], list):
            lines.append(f'  <link property="{key}" href="{_text(v)}">')
        else:
            lines.append(f'  <meta property="{key}" content="{_text(v)}">')
    return "\n".join([*lines, "</div>"])


def _each(made):
    def over(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                doc = json.loads(t)
            except (TypeError, ValueError):
                return None
            return made(doc) if isinstance(doc, dict) else None

        return texts.map(one)

    return over


@F.pandas_udf(StringType())
def microdata(doc: pd.Series) -> pd.Series:
    """Microdata of a JSON text, nodes within nodes; null for what is no object."""
    return _each(microdata_of)(doc)


@F.pandas_udf(StringType())
def rdfa(doc: pd.Series) -> pd.Series:
    """RDFa of a JSON text, nodes within nodes; null for what is no object."""
    return _each(rdfa_of)(doc)


def page(title: Column, body: Column, data: Column) -> Column:
    """An HTML page with its structured data in the head."""
    from ledgerloom.functions.text import html_escaped

    return F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'), html_escaped(title), F.lit("</title>\n"), data, F.lit("\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>"))


# properties from what other programs found out about a file: maps of texts to properties


def at(m: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(m, F.lit(key)), F.lit(""))


def from_exif(m: Column) -> dict[str, Column]:
    camera = F.concat_ws(" ", at(m, "Make"), at(m, "Model"))
    taken = F.coalesce(at(m, "DateTime"), at(m, "DateTimeOriginal"), at(m, "DateTimeDigitized"))
    return {
        "creator": person(at(m, "Artist")), "exifData": given(camera, node("PropertyValue", name=F.lit("Camera"), value=camera)),
        "dateCreated": F.regexp_replace(taken, r"^(\d+):(\d+):", "$1-$2-"), "width": at(m, "ImageWidth").try_cast("int"), "height": at(m, "ImageHeight").try_cast("int"), "copyrightNotice": at(m, "Copyright"), "description": at(m, "ImageDescription"),
        "contentLocation": place(F.lit("Photo Location"), at(m, "GPSLatitude").try_cast("double"), at(m, "GPSLongitude").try_cast("double")),
    }


def from_document(m: Column) -> dict[str, Column]:
    #: Properties of documents and what they are called in a schema.
    names = {"title": "name", "subject": "abstract", "description": "description", "keywords": "keywords", "created": "dateCreated", "modified": "dateModified", "language": "inLanguage", "pages": "numberOfPages"}
    return {new: at(m, old) for old, new in names.items()} | {"author": person(F.coalesce(at(m, "author"), at(m, "creator")))}


def from_audio(m: Column, seconds: Column) -> dict[str, Column]:
    from ledgerloom.functions.text import iso_duration

    album = at(m, "album")
    rate = at(m, "sample_rate")
    return {
        "name": at(m, "title"), "byArtist": person(at(m, "artist")), "inAlbum": given(album, node("MusicAlbum", F.concat(F.lit("urn:uuid:"), ids.uuid5(ids.ALBUM, ids.normalized(album))), name=album)), "genre": at(m, "genre"),
        "duration": F.when(seconds.isNotNull(), iso_duration(seconds)), "bitrate": F.concat(at(m, "bitrate"), F.lit("kbps")), "encodingFormat": given(rate, F.concat(F.lit("audio/mpeg ("), rate, F.lit("Hz)"))),
        "position": at(m, "track_number").try_cast("int"), "datePublished": F.concat(at(m, "year"), F.lit("-01-01")),
    }


def from_video(m: Column, seconds: Column, now: Column) -> dict[str, Column]:
    from ledgerloom.functions.text import iso_duration

    return {
        "name": at(m, "title"), "description": at(m, "description"), "width": at(m, "width").try_cast("int"), "height": at(m, "height").try_cast("int"), "duration": F.when(seconds.isNotNull(), iso_duration(seconds)),
        "bitrate": F.concat(at(m, "bitrate"), F.lit("kbps")), "videoCodec": at(m, "codec"), "audioCodec": at(m, "audio_codec"), "uploadDate": F.coalesce(at(m, "upload_date"), now),
    }


def from_code(m: Column, dependencies: Column, functions: Column) -> dict[str, Column]:
    used = F.transform(dependencies, lambda d: node("SoftwareApplication", name=F.split(d, "==")[0], softwareVersion=F.coalesce(F.try_element_at(F.split(d, "=="), F.lit(2)), F.lit(""))))
    return {
        "programmingLanguage": at(m, "language"), "codeRepository": at(m, "repository"), "targetProduct": at(m, "branch"), "dependencies": F.when(F.size(dependencies) > 0, used), "runtimePlatform": at(m, "runtime"),
        "license": at(m, "license"), "author": person(at(m, "author")), "description": F.when(functions.isNotNull(), F.concat(F.lit("Contains "), functions.cast("string"), F.lit(" functions"))),
    }


def from_dataset(m: Column, columns: Column, rows: Column) -> dict[str, Column]:
    span = F.coalesce(F.when(at(m, "start").isNotNull() | at(m, "end").isNotNull(), F.concat(F.coalesce(at(m, "start"), F.lit("")), F.lit("/"), F.coalesce(at(m, "end"), F.lit("")))), at(m, "temporal"))
    return {
        "name": at(m, "name"), "description": at(m, "description"), "variableMeasured": F.when(F.size(columns) > 0, F.transform(columns, lambda c: node("PropertyValue", name=c, description=F.lit("")))), "temporalCoverage": span,
        "spatialCoverage": at(m, "spatial"), "distribution": given(at(m, "format"), F.array(node("DataDownload", encodingFormat=at(m, "format")))), "additionalProperty": F.when(rows.isNotNull(), F.array(node("PropertyValue", name=F.lit("rows"), value=rows))),
    }


def entity_kind(label: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ENTITY_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.upper(label)), F.lit("Thing"))


def from_language(keywords: Column, topics: Column, entities: Column, language: Column, summary: Column) -> dict[str, Column]:
    """``entities``: array of structs (label, name), each with an id of its kind."""

    def mention(e: Column) -> Column:
        kind, key = entity_kind(e["label"]), ids.normalized(e["name"])
        iri = F.when(kind == "Person", ids.uuid5(ids.NAMESPACES["person"], key)).when(kind == "Organization", ids.uuid5(ids.NAMESPACES["company"], key)).when(kind == "Place", ids.uuid5(ids.NAMESPACES["location"], key)).otherwise(ids.uuid5(ids.THING, key))
        return node(kind, F.concat(F.lit("urn:uuid:"), iri), name=e["name"])

    return {
        "keywords": F.when(F.size(keywords) > 0, F.array_join(keywords, ", ")), "about": F.when(F.size(topics) > 0, F.transform(topics, lambda t: node("Thing", name=t))), "mentions": F.when(F.size(entities) > 0, F.transform(entities, mention)),
        "inLanguage": language, "abstract": summary,
    }


def enriched(*sources: dict[str, Column]) -> dict[str, Column]:
    """Properties of all sources; a later source's value holds unless it is null."""
    out: dict[str, Column] = {}
    for s in sources:
        for k, v in s.items():
            out[k] = F.coalesce(v, out[k]) if k in out else v
    return out
