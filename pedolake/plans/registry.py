"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import completeness, environment, modelling, raster, statistics

FAMILIES = [completeness, statistics, raster, environment, modelling]


def queries() -> dict:
    """Name to callable (spark, sf_dir)."""
    return {f.__name__: f for family in FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
