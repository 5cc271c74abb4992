"""Registered queries.  Importing the modules fills the registry."""

from turnbook.plans import ingest_queries, intraday_queries, market_queries, ranking_queries, storage_queries, stream_queries  # noqa: F401
from turnbook.plans.registry import REGISTRY  # noqa: F401
