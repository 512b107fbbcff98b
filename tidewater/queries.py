"""Queries by name and their SQL equivalents, for the market's operators."""

from __future__ import annotations

from tidewater import queries_decisions, queries_features, queries_quality, queries_scoring, queries_stations, queries_tables

MODULES = (queries_features, queries_decisions, queries_scoring, queries_quality, queries_stations, queries_tables)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
