"""All queries of the engine with their DuckDB statements."""

from __future__ import annotations

from . import more, queries  # noqa: F401  `more` adds to the tables of `queries`

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
