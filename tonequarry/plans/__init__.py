"""Queries bound to tables, with their SQL."""

from __future__ import annotations

from tonequarry.plans import media, reports, sessions, timelines

_MODULES = (media, timelines, reports, sessions)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
