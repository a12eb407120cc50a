"""Every query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from ontospark.plans import pipeline, problems, reference

_MODULES = [reference, pipeline, problems]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
