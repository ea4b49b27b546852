"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from aerogrid.plans import (  # noqa: F401
    balanced_queries,
    evaluation_queries,
    join_queries,
    model_queries,
    prep_queries,
    quality_queries,
    result_queries,
    scalar_queries,
    source_queries,
    window_queries,
)
from aerogrid.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)
