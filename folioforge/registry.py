"""Queries of the library's own operators, and their SQL, by name."""

from __future__ import annotations

from folioforge.queries import analysis, cases, fulltext, library, review, text, web, writing

MODULES = (library, text, web, fulltext, analysis, cases, review, writing)

QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
