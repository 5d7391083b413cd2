"""Registered queries with their equivalent SQL."""

from __future__ import annotations

from registry import activity, demand, geography, ingest, profile_groups, queueing, weather

MODULES = (ingest, activity, geography, queueing, profile_groups, demand, weather)


def all_queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
