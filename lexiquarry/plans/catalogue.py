"""All queries by name, each with its SQL."""

from __future__ import annotations

from lexiquarry.plans import audits, layouts, lines, records, rules, search, serving, texts

_PARTS = (records, lines, search, texts, rules, layouts, audits, serving)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
