"""Imports every query module so that the registry is complete."""

from shelfsight.plans import (  # noqa: F401
    catalog_queries, compare_queries, ingest_queries, review_queries, state_queries, stream_queries, text_queries,
)
from shelfsight.plans.registry import QUERIES  # noqa: F401
