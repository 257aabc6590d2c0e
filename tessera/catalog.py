"""All core queries and their SQL, collected from the query modules."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "search_pipeline"

MODULES = ["tessera.plans.docproc", "tessera.plans.tables", "tessera.plans.search", "tessera.plans.graph", "tessera.plans.streams"]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= import_module(m).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= import_module(m).SQL
    return found
