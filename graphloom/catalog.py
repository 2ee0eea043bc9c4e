"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from graphloom import experiment_queries  # noqa: F401  (registers its queries)
from graphloom.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
