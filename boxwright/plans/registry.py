"""The catalogue of queries: each has a key, a Spark plan, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under ``key`` with its oracle."""

    def add(plan: Plan) -> Plan:
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = plan
        if sql is not None:
            SQL[key] = sql
        return plan

    return add


def load() -> tuple[dict[str, Plan], dict[str, str]]:
    """Every plan and oracle of the library."""
    from boxwright.plans import aggregate_queries, cluster_queries, filter_queries, geometry_queries, join_queries, quality_queries, sampling_queries, source_queries, stream_queries, trust_queries, window_queries  # noqa: F401

    return dict(PLANS), dict(SQL)
