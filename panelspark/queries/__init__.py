"""Registered queries, one or more per operator, with an equivalent SQL text where one exists."""

from . import registry
from .registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql", "registry"]
