"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from onomast.plans import etl_queries, more_queries, retrieval_queries, span_queries

_MODULES = [etl_queries, retrieval_queries, span_queries, more_queries]
QUERIES = {name: of for m in _MODULES for name, of in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
