"""Imports every query module and hands out the registry."""

from __future__ import annotations

from fieldbook.plans import audit_queries, cell_queries, event_queries, extract_queries, graph_queries, hours_queries, lookup_queries, page_queries, quality_queries, retrieval_queries, table_queries, text_queries  # noqa: F401
from fieldbook.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
