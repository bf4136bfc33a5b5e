"""Registry of named queries: Spark callables and their DuckDB oracle SQL.

Each query module registers ``name → fn(spark, sf_dir) -> DataFrame`` and,
where the result is expressible in SQL, ``name → sql``. Output columns carry
the same names on both sides; doubles are rounded to 4 decimals on both sides
so the order-insensitive value hash is stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    # Importing the modules fills the registry.
    from cohortlens.plans import (  # noqa: F401
        q_features,
        q_stats,
        q_segments,
        q_cluster,
        q_text,
        q_log,
        q_stream,
        q_explain,
        q_views,
        q_embed,
        q_density,
    )
