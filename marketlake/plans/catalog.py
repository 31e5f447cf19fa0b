"""All registered queries; importing a module registers what it defines."""

from marketlake.plans import (  # noqa: F401
    declared_queries, job_queries, market_queries, signal_queries, storage_queries, stream_queries, symbol_queries,
    transition_queries,
)
from marketlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
