"""Ordered rule lists as one column; the lists are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASS = "struct<category:string,subcategory:string>"


@dataclass(frozen=True)
class Rule:
    """A row whose ``column`` matches ``pattern`` gets the class; with ``ignore_case`` in whatever case."""

    pattern: str
    category: str
    subcategory: str
    column: str = "filename"
    ignore_case: bool = True


def classified(rules: list[Rule]) -> Column:
    """The class of the first rule that holds, as a struct, or null."""
    out = None
    for r in rules:
        hit = F.col(r.column).rlike(("(?iu)" if r.ignore_case else "") + r.pattern)
        value = F.struct(F.lit(r.category).alias("category"), F.lit(r.subcategory).alias("subcategory"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast(CLASS) if out is None else out


def looked_up(key: Column, table: dict[str, tuple[str, str]]) -> Column:
    """The class of a key in a fixed table, or null."""
    entries = [x for k, (c, s) in table.items() for x in (F.lit(k), F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory")))]
    return F.try_element_at(F.create_map(*entries), key)


def keyword_class(text: Column, words: dict[str, list[str]], least: int) -> Column:
    """The first class of which ``least`` different keywords occur."""
    present = {k: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w))) >= least for k, ws in words.items()}
    out = None
    for k, hit in present.items():
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out


def by_thresholds(scores: Column, rules: list[tuple[str, list[str], float]], default: str) -> Column:
    """The first label for which the greatest of some scores of a map passes a threshold."""
    out = None
    for label, names, least in rules:
        top = F.greatest(*[F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) for n in names], F.lit(0.0))
        out = F.when(top > least, F.lit(label)) if out is None else out.when(top > least, F.lit(label))
    return out.otherwise(F.lit(default))
