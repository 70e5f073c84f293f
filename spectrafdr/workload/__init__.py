"""Registered queries over the given tables."""

from spectrafdr.workload import (  # noqa: F401
    fdr_queries,
    feature_queries,
    job_queries,
    robust_queries,
    source_queries,
    value_queries,
)
from spectrafdr.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
