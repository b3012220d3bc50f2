"""The query catalogue: QUERIES (name -> callable) and ORACLE_SQL (name -> DuckDB text)."""

from . import bounded_queries, graph_queries, memory_queries, recall_queries, rule_queries

_PARTS = (recall_queries, graph_queries, bounded_queries, memory_queries, rule_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
