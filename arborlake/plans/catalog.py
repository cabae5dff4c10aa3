"""All registered queries."""

from __future__ import annotations

from arborlake.plans import fold_queries, function_queries, graph_queries, state_queries, status_queries  # noqa: F401
from arborlake.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
