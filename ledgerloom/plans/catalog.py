"""Every registered query: importing this module imports the modules that register them."""

from __future__ import annotations

from . import assessment_queries, case_queries, evaluation_queries, experiment_queries, graph_queries, narrative_queries, record_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
