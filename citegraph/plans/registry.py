"""Query registry: name -> Spark callable and name -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


_STAGES: dict = {}


def stage(spark, d: str, name: str, build):
    """Session-scoped memo of an intermediate table (an edge matrix, a centroid
    table ...): built once per (application, input folder), then reused."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def clear_stages() -> None:
    """Forget all memoised tables (the benchmark times every query from scratch)."""
    _STAGES.clear()


def load_all() -> None:
    # Importing the modules fills the registry.
    from citegraph.plans import (  # noqa: F401
        graph_queries,
        relational_queries,
        text_queries,
        consensus_queries,
        scoring_queries,
        source_queries,
    )
