"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gridloom.llm import decontaminate, langid, lines, media, packing, passages, quality, search, shards, simhash, spelling, tokens, urls

MODULES = [simhash, media, tokens, quality, passages, urls, packing, langid, lines, decontaminate, spelling, search, shards]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
