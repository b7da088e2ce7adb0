"""All named queries of the library and their DuckDB SQL."""

from __future__ import annotations

from . import oracle, queries, studies, upkeep

QUERIES = queries.QUERIES | upkeep.QUERIES | studies.QUERIES
SQL = oracle.SQL | upkeep.SQL | studies.SQL
