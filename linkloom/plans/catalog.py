"""Registered queries of the page-graph engine and their SQL oracles."""

from __future__ import annotations

from linkloom.plans import crawl_queries, graph_queries, page_queries, parse_queries, state_queries, store_queries, stream_queries  # noqa: F401  they register themselves
from linkloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
