"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import analysis_queries, document_queries, retrieval_queries, service_queries

MODULES = (retrieval_queries, document_queries, analysis_queries, service_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
