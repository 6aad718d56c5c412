"""Registered queries and their statements for DuckDB."""

from . import q_graph, q_more, q_relational, q_sources, q_split, q_text, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
