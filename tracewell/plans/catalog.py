"""Imports every query module and exposes the filled tables."""

from tracewell.plans import (  # noqa: F401
    bayes_queries,
    contract_queries,
    experiment_queries,
    model_queries,
    prepare_queries,
    reference_queries,
    scoring_queries,
    source_queries,
)
from tracewell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
