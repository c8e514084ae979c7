"""Registered queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from . import graph_queries, memory_queries, mutation_queries, read_queries, session_queries

QUERIES = memory_queries.QUERIES | session_queries.QUERIES | graph_queries.QUERIES | mutation_queries.QUERIES | read_queries.QUERIES
ORACLE_SQL = memory_queries.ORACLE_SQL | session_queries.ORACLE_SQL | graph_queries.ORACLE_SQL | mutation_queries.ORACLE_SQL | read_queries.ORACLE_SQL
