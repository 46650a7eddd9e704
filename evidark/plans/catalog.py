"""All registered queries of the engine; importing the modules below registers them."""

from __future__ import annotations

from evidark.plans import corpus_queries, model_queries, outcome_queries, preparation_queries, routing_queries, span_queries  # noqa: F401
from evidark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
