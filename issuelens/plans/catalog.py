"""All named queries. Importing the modules fills the registry."""

from issuelens.plans import (  # noqa: F401
    io_queries,
    label_queries,
    metric_queries,
    sampling_queries,
    scoring_queries,
    stream_queries,
    text_queries,
    training_queries,
)
from issuelens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
