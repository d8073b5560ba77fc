"""Registered queries over the given tables."""
from . import (  # noqa: F401
    answers, history, linking, lint, queues, ranges, scalars, setup, tables, worklists, writeback,
)
from . import checks  # noqa: F401  reads a query of tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
