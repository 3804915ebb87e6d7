"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from quire.catalog import records, search, streams, structure, text

QUERIES = {**text.QUERIES, **structure.QUERIES, **records.QUERIES, **streams.QUERIES, **search.QUERIES}
ORACLE_SQL = {**text.ORACLE_SQL, **structure.ORACLE_SQL, **records.ORACLE_SQL, **streams.ORACLE_SQL, **search.ORACLE_SQL}
