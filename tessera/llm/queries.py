"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

from importlib import import_module

#: Fixed value: module -> its queries.
_BY_MODULE = {
    "residue": ["p1_found", "p1_windows"],
    "history": ["p2_found"],
    "sitelines": ["p3_found", "p3_clean", "p3_boilerplate"],
    "truncation": ["p4_found", "p4_report"],
    "pagebody": ["p5_found", "p5_clean"],
    "encode": ["p6_ids"],
    "mix": ["p7_mix", "p7_report"],
    "pii": ["p8_found", "p8_redacted", "p8_surrogates"],
}


def queries() -> dict:
    return {name: getattr(import_module(f"tessera.llm.{module}"), name) for module, names in _BY_MODULE.items() for name in names}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _BY_MODULE:
        found |= getattr(import_module(f"tessera.llm.{module}"), "ORACLE", {})
    return found
