"""All queries over the reference's operators, and their oracles."""

from __future__ import annotations

from vigilspark.plans import decoding_queries, detection_queries, fusion_queries, library_queries, runtime_queries

MODULES = (fusion_queries, library_queries, detection_queries, decoding_queries, runtime_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
