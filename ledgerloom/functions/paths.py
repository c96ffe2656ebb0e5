"""Columns on file paths and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last suffix with its dot; none for names that begin with their only dot or end in one."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def double_suffix(name: Column) -> Column:
    """The last two suffixes together, or nothing."""
    return F.regexp_extract(name, r"^.+?(\.[^.]+\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    """The folder's own name; null for a bare name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def project_folder(path: Column, generic: list[str]) -> Column:
    """The nearest folder upwards that is neither a generic nor a hidden one."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    return F.try_element_at(F.filter(folders, lambda x: (x != "") & ~x.startswith(".") & ~F.lower(x).isin(generic)), F.lit(1))


def clean_folder(name: Column, most: int = 50) -> Column:
    """Without characters that file systems forbid, white space collapsed, cut to ``most``."""
    kept = F.regexp_replace(name, r'[<>:"/\\|?*]', "")
    return F.trim(F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, most))


def clean_filename(name: Column, most: int = 60) -> Column:
    """Words joined by single underscores, cut to ``most``."""
    kept = F.regexp_replace(name, r"[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(F.trim(kept), r"\s+", "_"), "_+", "_")
    return F.rtrim(F.substring(joined, 1, most), F.lit("_"))


def hidden_or_system(name: Column, path: Column, keep: list[str], names: list[str], folders: list[str]) -> Column:
    """Whether a scan leaves the file out."""
    return (name.startswith(".") & ~name.isin(keep)) | name.isin(names) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def tokens(name: Column) -> Column:
    """Words of a file name: split at separators and at changes between letters and digits or cases, lower case, longer than one.

    The name is taken in its decomposed compatibility form, so a letter with an accent counts as the letter and a mark. Capitals before a
    capitalised word are a word of their own; a part without any Latin letter or digit stays whole.
    """
    parts = F.split(decomposed(stem(name)), r"(?U)[_\-\s.]+")
    found = lambda w: F.regexp_extract_all(w, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|[^\p{L}\p{N}_]|\p{Nd}|$)|\p{Nd}+"), F.lit(0))
    words = F.flatten(F.transform(parts, lambda w: F.when(F.size(found(w)) > 0, found(w)).otherwise(F.array(w))))
    return F.filter(F.transform(words, F.lower), lambda w: F.length(w) > 1)


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def decomposed(text: Column) -> Column:
    """Decomposed compatibility form (NFKD); plain ASCII isn't sent to Python."""
    return F.coalesce(_nfkd(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
