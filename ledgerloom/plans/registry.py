"""Every registered query of the core with its SQL."""

from __future__ import annotations

from ledgerloom.plans import analytics, catalog, classes, documents, etl, files, links, scalars, streams

_MODULES = [catalog, classes, documents, etl, files, links, scalars, analytics, streams]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
