"""Queries over the driver's tables."""

from . import decision_queries, io_queries, url_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
