"""Every registered query of the library with its SQL."""

from __future__ import annotations

from gridloom.plans import evaluation, imagery, labelling, splitting, stitching, tilings

MODULES = [evaluation, stitching, tilings, labelling, splitting, imagery]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
