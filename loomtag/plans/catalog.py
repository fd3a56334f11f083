"""All registered queries and their SQL."""

from loomtag.plans import evaluation_queries, ranking_queries, sequence_queries, source_queries, streaming_queries, tagging_queries, text_queries  # noqa: F401
from loomtag.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
