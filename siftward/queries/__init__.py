"""Queries over the given tables, each with its oracle where SQL can state it."""

from siftward.queries import (  # noqa: F401
    boundary_queries,
    corpus_queries,
    label_queries,
    model_queries,
    package_queries,
)
from siftward.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
