"""Columns on texts, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(text: Column, word: str) -> Column:
    """Occurrences of ``word`` that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def matches_any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern is found, in the order of ``patterns``."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]))


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """An ordered cascade: the value of the first rule that holds."""
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return default if out is None else out.otherwise(default)


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    one = lambda c, unit: F.concat(F.format_string("%.1f", c), F.lit(unit))
    return F.when(seconds < 60, one(seconds, "s")).when(seconds < 3600, one(seconds / 60, " min")).otherwise(one(seconds / 3600, " h"))


def iso_duration(seconds: Column) -> Column:
    """``PT#H#M#S`` without zero parts; ``PT0S`` for none."""
    s = F.floor(seconds).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(s == 0, "PT0S").otherwise(F.concat(F.lit("PT"), part(h, "H"), part(m, "M"), part(r, "S")))


def exif_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))


def title_label(text: Column) -> Column:
    """Words at ``_`` and ``/`` with a capital first letter, the rest as it is."""
    return F.array_join(F.transform(F.split(text, "[_/]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a signed decimal."""
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def merged(*maps: Column) -> Column:
    """Later maps win; their nulls don't hide earlier values."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(b, a))
    return out


def completeness(present: Column, required: list[str], recommended: list[str]) -> Column:
    """Share of the required properties, each recommended one counting half, at most 1."""
    if not required:
        return F.lit(1.0)
    have = lambda names: F.size(F.array_intersect(present, F.array(*map(F.lit, names)))) if names else F.lit(0)
    return F.least((have(required) + 0.5 * have(recommended)) / len(required), F.lit(1.0))


def missing(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def unique_names(names: Column) -> Column:
    """Names with single blanks, longer than two, each once in whatever case, the first spelling in place."""
    plain = F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    low = F.transform(plain, F.lower)
    return F.filter(plain, lambda x, i: (F.length(x) > 2) & (F.array_position(low, F.lower(x)) == i + 1))


def report_time(name: Column) -> Column:
    """The time in a name like ``..._20250131_093000.json``, null if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
