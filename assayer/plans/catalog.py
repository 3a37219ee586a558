"""All queries of the library by name, and their SQL."""

from assayer.plans import audit_queries, queries, run_queries  # noqa: F401  all register theirs
from assayer.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
