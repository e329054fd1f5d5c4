"""Queries of this subpackage, and their SQL, by name."""

from __future__ import annotations

from folioforge.llm import alignment, bpe, chat, langid, linededup, mixing, multiindex, pii, quality_ranker, quality_rules, sharding, simhash, vector_codes

MODULES = (alignment, bpe, chat, langid, linededup, mixing, multiindex, pii, quality_ranker, quality_rules, sharding, simhash, vector_codes)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
