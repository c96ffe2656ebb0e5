"""Every registered query of this subpackage with its SQL."""

from __future__ import annotations

from ledgerloom.llm import queries_entities, queries_names, queries_text

_MODULES = [queries_entities, queries_names, queries_text]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
