"""All registered queries. Importing the modules registers their contents."""

from __future__ import annotations

from . import community_queries, source_queries, study_queries, tabular_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
