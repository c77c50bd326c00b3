"""All queries over the engine's own operators, and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("actions", "graph", "retrieval", "ranked", "texts", "simulation", "reports", "files", "forms", "stored", "driver")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"swarmlens.queries.{name}").QUERIES
    return found


def queries() -> dict:
    return {name: pair[0] for name, pair in _all().items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {name: pair[1] for name, pair in _all().items() if pair[1] is not None}
