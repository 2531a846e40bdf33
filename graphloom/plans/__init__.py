"""Registered queries of the library and their SQL."""

from . import graph_queries, learn_queries, resolve_queries, retrieval_queries, source_queries, stream_queries, surface_queries, text_queries, triple_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
