"""Registry of the core queries and their DuckDB equivalents."""

from __future__ import annotations

from lodestone.plans import briefs, content, jobs, library, lifecycle, retrieval, saves, schedule, search, upkeep

MODULES = [library, search, content, jobs, briefs, lifecycle, schedule, retrieval, upkeep, saves]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
