"""The registered queries and their SQL twins."""

from __future__ import annotations

from . import queries_catalogue, queries_linked, queries_scalar, queries_scan

QUERIES: dict = queries_scan.QUERIES | queries_scalar.QUERIES | queries_linked.QUERIES | queries_catalogue.QUERIES
ORACLE_SQL: dict[str, str] = queries_scan.ORACLE_SQL | queries_scalar.ORACLE_SQL | queries_linked.ORACLE_SQL | queries_catalogue.ORACLE_SQL
