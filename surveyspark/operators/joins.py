"""Join operators (JN-*). The planner picks the physical strategy; lookups are
broadcast only when their size is fixed by construction or checked."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_K = "__one"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, as they do in a group-by; keys come from the left."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)],
                         *[F.col(c) for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__rk{i}"))
    return left.join(named, on, how).drop(*[f"__rk{i}" for i in range(len(keys))])


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left",
                max_rows: int | None = 1_000_000) -> DataFrame:
    """JN-1: left equi-join to a lookup; broadcast after a bounded size check."""
    from surveyspark.functions.exprs import bounded_broadcast
    lk = bounded_broadcast(lookup, max_rows) if max_rows else lookup
    return df.join(lk, on, how)


def attach_split(df: DataFrame, split_table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """JN-2: attach the ``key -> split`` assignment (one row per cluster; rows without a cluster are one cluster).

    The split table has one row per distinct cluster, so its size grows with
    the number of clusters, not rows; the planner decides broadcast vs shuffle.
    """
    return null_safe_join(df, split_table, [key], how)


def keep_split(df: DataFrame, split_table: DataFrame, key: str, split: str, col: str = "split") -> DataFrame:
    """JN-2: semi join - rows whose cluster belongs to ``split``."""
    return null_safe_join(df, split_table.where(F.col(col) == split).select(key), [key], "left_semi")


def drop_split(df: DataFrame, split_table: DataFrame, key: str, split: str, col: str = "split") -> DataFrame:
    """JN-2: anti join - rows whose cluster is not in ``split``."""
    return null_safe_join(df, split_table.where(F.col(col) == split).select(key), [key], "left_anti")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """JN-4: attach a one-row aggregate (medians, rates) to every row.

    Expressed as an uncorrelated scalar subquery (``DataFrame.scalar()``) that
    returns all the aggregate's columns as one struct: Spark runs it once and
    inlines the result, so no join (and no nested-loop plan) is needed.
    """
    cols = one_row.columns
    sub = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_s")).scalar()
    out = df.withColumn(_K, sub)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(_K)[c].alias(c) for c in cols])
