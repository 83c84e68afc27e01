"""All queries of the library outside ``llm``, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("documents", "extracts", "service", "relational", "streams", "shaped", "decked", "phrased", "assisted", "solved", "desked", "marked", "paged", "pictured", "laid", "enumerated", "enriched", "filed", "fitted")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"deckloom.plans.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
