"""Registered queries: each operator over the given tables, next to the SQL that has to give the same result."""

from queries import cleaning, comparing, dates, encoding, features, plans, profiling, scaling, sources, text, validation
from queries.registry import oracle, registered

__all__ = [
    "cleaning", "comparing", "dates", "encoding", "features", "oracle", "plans", "profiling", "registered", "scaling",
    "sources", "text", "validation",
]
