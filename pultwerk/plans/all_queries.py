"""Importing this module registers every query."""

from pultwerk.plans import consensus_queries, privacy_queries, record_queries, retrieval_queries, review_queries, school_queries, source_queries, stream_queries, usage_queries  # noqa: F401
from pultwerk.plans.registry import ORACLES, QUERIES  # noqa: F401
