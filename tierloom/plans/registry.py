"""Queries over the reference tables and their SQL oracles."""

from . import audit_queries, corpus_queries, interval_queries, relation_queries, report_queries, selection_queries, space_queries, table_queries

_PARTS = (corpus_queries, interval_queries, space_queries, relation_queries, selection_queries, audit_queries, report_queries, table_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
