"""Registry of the subpackage's bound queries and their DuckDB oracle SQL."""

from __future__ import annotations

import functools
from typing import Callable

from surveyspark.llm.common import small_batches
from surveyspark.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco
