"""The queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from .plans.queries import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
