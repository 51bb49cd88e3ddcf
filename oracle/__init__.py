"""DuckDB formulations the Spark queries are compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["impact", "views", "questions", "checks", "study", "blocks", "deliverables"]


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"oracle.{name}").sql())
    return out
