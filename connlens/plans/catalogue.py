"""All registered queries."""

from connlens.plans import (  # noqa: F401  (registration)
    feature_queries,
    join_queries,
    label_queries,
    learning_queries,
    model_queries,
    report_queries,
    source_queries,
    stream_queries,
)
from connlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
