"""All queries of the library, gathered from their modules."""

from __future__ import annotations

from memspark import queries_documents, queries_files, queries_graph, queries_library, queries_links, queries_memory, queries_more, queries_regions, queries_retrieval, queries_routes, queries_state, queries_stored, queries_text, queries_training  # noqa: F401
from memspark.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = QUERIES["r4_hybrid_retrieval"]
