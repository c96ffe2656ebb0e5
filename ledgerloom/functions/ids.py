"""Deterministic identifiers as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of the entity types, and what the URN of a file begins with.
NAMESPACES = {
    "file": uuid.UUID("f4e8a9c0-1234-5678-9abc-def012345678"),
    "category": uuid.UUID("c4e8a9c0-2345-6789-abcd-ef0123456789"),
    "company": uuid.UUID("c0e1a2b3-4567-89ab-cdef-012345678901"),
    "person": uuid.UUID("d1e2a3b4-5678-9abc-def0-123456789012"),
    "location": uuid.UUID("e2e3a4b5-6789-abcd-ef01-234567890123"),
    "session": uuid.UUID("f3e4a5b6-789a-bcde-f012-345678901234"),
    "merge_event": uuid.UUID("a1b2c3d4-89ab-cdef-0123-456789abcdef"),
}
THING, ALBUM = uuid.UUID("a0b1c2d3-4567-89ab-cdef-0123456789ab"), uuid.UUID("b1c2d3e4-5678-9abc-def0-123456789abc")
FILE_URN = "urn:sha256:"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def file_id(path: Column) -> Column:
    return F.sha2(path, 256)


def file_iri(path: Column) -> Column:
    return F.concat(F.lit(FILE_URN), file_id(path))


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")


def uuid5(namespace: uuid.UUID, key: Column) -> Column:
    """Version-5 UUID of ``key``, by SHA-1 inside the JVM."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def to_iri(value: Column) -> Column:
    """An IRI as it is; a UUID or a SHA-256 as URN; anything else as a name-based UUID."""
    v = F.trim(value)
    low = F.lower(v)
    return (
        F.when(v.rlike("^(urn:|https?://|ftp://|file://|mailto:|data:)"), v)
        .when(low.rlike(UUID), F.concat(F.lit("urn:uuid:"), low))
        .when(low.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(FILE_URN), low))
        .otherwise(F.concat(F.lit("urn:uuid:"), uuid5(NAMESPACES["file"], v)))
    )


def quoted(text: Column) -> Column:
    """Percent-encoded, with %20 for a blank; letters, digits and ``-._~`` stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
