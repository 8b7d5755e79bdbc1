"""All registered queries; importing this module fills the registry."""

from crivo.plans import (  # noqa: F401
    clean_queries,
    compare_queries,
    encode_queries,
    model_queries,
    score_queries,
    screening_queries,
    union_queries,
)
from crivo.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
