"""Registry of named queries: a Spark builder and, where SQL can express it,
an equivalent DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}
# Queries the default benchmark leaves out (many sequential model fits).
SLOW: set[str] = set()


def register(name: str, oracle: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        OPERATORS[name] = operators
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from tidewatch.plans import (  # noqa: F401
        attribution_plans, clean_plans, drift_plans, eval_plans, inject_plans, job_plans, model_plans,
        profile_plans, registry_plans, sink_plans, training_plans, window_plans,
    )
