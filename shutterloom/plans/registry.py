"""All catalog queries by name, and their SQL twins."""

from __future__ import annotations

from . import coverage, dashboards, decisions, groups, learning, live, tables

_MODULES = (dashboards, decisions, groups, learning, tables, coverage, live)


def queries() -> dict:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .views import with_views

    return {name: with_views(sql) for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
