"""Distributed building blocks shared by profiling, cleaning and inference.

Columns are stacked to (keys..., variable, value). Moments are one aggregate over that form, quantiles a
distributed selection by refining bin counts; neither shuffles values. Only the mode and the tie-aware metrics count
distinct values: a map-side partial aggregate makes a hot value (a third of all rows) one row per task.
Global orders come from ``ordered_buckets``: range partitions and prefix sums, so no task sorts a whole group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.operators.joins import null_safe_join

VAR = "variable"
VAL = "value"


def per_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Broadcast a per-variable table only when no extra group keys exist (then its size is
    bounded by the number of columns); keyed tables grow with the data and are left to the
    planner and AQE."""
    return F.broadcast(df) if not list(keys) else df


def long_form(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
              var: str = VAR, val: str = VAL, drop_null: bool = True) -> DataFrame:
    """Stack numeric columns into (keys..., variable, value DOUBLE)."""
    sel = df.select(*keys, *[F.col(x).cast("double").alias(x) for x in cols])
    out = sel.unpivot(list(keys), list(cols), var, val)
    return out.where(F.col(val).isNotNull()) if drop_null else out


def value_counts(long_df: DataFrame, keys: Sequence[str] = (), var: str = VAR,
                 val: str = VAL, weight: str | None = None) -> DataFrame:
    """(keys..., variable, value, n[, w]) - one row per distinct value."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight:
        aggs.append(F.sum(weight).alias("w"))
    return long_df.groupBy(*keys, var, val).agg(*aggs)


def moments(long_df: DataFrame, keys: Sequence[str] = (), var: str = VAR, val: str = VAL) -> DataFrame:
    """n, mean, sample sd/variance, min, max, population skewness g1 and excess kurtosis g2, in one aggregate.

    Spark's central-moment aggregates merge partial results stably, so only one
    row per (keys, variable) and task is shuffled.
    """
    v = F.col(val)
    spread = F.max(v) > F.min(v)
    return long_df.groupBy(*keys, var).agg(
        F.count(v).alias("n_obs"), F.avg(v).alias("mean"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).alias("sd"), F.when(F.count(v) > 1, F.var_samp(v)).alias("variance"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(spread, F.skewness(v)).alias("g1"), F.when(spread, F.kurtosis(v)).alias("g2"))


def mode(long_df: DataFrame, keys: Sequence[str] = (), var: str = VAR, val: str = VAL) -> DataFrame:
    """Most frequent value; ties go to the lowest value (pandas ``mode().iloc[0]``).

    A mode needs the count of every distinct value; a hot value is one partial count per task.
    """
    gk = [*keys, var]
    best = F.max(F.struct(F.col("n"), (-F.col(val)).alias("neg")))
    return (value_counts(long_df, keys, var, val).groupBy(*gk).agg(best.alias("_b"))
            .select(*gk, (-F.col("_b.neg")).alias("mode")))


def quantiles(long_df: DataFrame, probs: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] | None = None,
              var: str = VAR, val: str = VAL, bins: int = 1024, finish: int = 50_000) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``): one column per probability.

    Distributed selection: the interval from the smallest to the largest value
    is cut into ``bins``; a pass counts the rows of each bin (map-side, at most
    ``bins`` rows per interval are shuffled) with its own smallest and largest
    value, and only the bin that holds a target rank goes on. A bin with one
    value is an answer; a bin with at most ``finish`` rows is ranked whole. The
    plan is the same at every size and for every distribution, and no task ever
    holds more than ``finish`` rows of a group. Rows without a value don't count.
    """
    from surveyspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(long_df.sparkSession)
    gk = [*keys, var]
    names = list(names) if names else [f"q{int(round(p * 1000)):04d}" for p in probs]
    rows = long_df.select(*gk, F.col(val).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ends = rows.groupBy(*gk).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).checkpoint(eager=True)
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(x).cast("long"), F.least(F.floor(x).cast("long") + 1, F.col("_n") - 1)) for x in h])))
    # a target: the row of 0-based rank _k lies in [_lo, _hi], which holds _m rows and has _before rows below it
    targets = ends.select(*gk, F.explode(wanted).alias("_k"), "_lo", "_hi", F.col("_n").alias("_m"), F.lit(0).cast("long").alias("_before"))
    # every round makes progress: the lowest and the highest value of an interval never share a bin
    while targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_m") > finish)).limit(1).count():
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_m") > finish)
        spans = targets.where(wide).select(*gk, "_lo", "_hi").distinct()
        inside = _within(rows, spans, gk)
        held = inside.groupBy(*gk, "_lo", "_hi", _bin(bins).alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_l2"), F.max("_x").alias("_h2"))
        upto = Window.partitionBy(*gk, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_p", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        at = F.col("_k") - F.col("_before")
        cut = null_safe_join(targets.where(wide), held, [*gk, "_lo", "_hi"]).where((F.col("_p") <= at) & (at < F.col("_p") + F.col("_c")))
        cut = cut.select(*gk, "_k", F.col("_l2").alias("_lo"), F.col("_h2").alias("_hi"), F.col("_c").alias("_m"),
                         (F.col("_before") + F.col("_p")).alias("_before"))
        targets = targets.where(~wide).unionByName(cut).checkpoint(eager=True)
    few = F.col("_lo") < F.col("_hi")
    spans = targets.where(few).select(*gk, "_lo", "_hi").distinct()
    inside = _within(rows, spans, gk).groupBy(*gk, "_lo", "_hi", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*gk, "_lo", "_hi").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_p", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    at = F.col("_k") - F.col("_before")
    ranked = null_safe_join(targets.where(few), inside, [*gk, "_lo", "_hi"]).where((F.col("_p") <= at) & (at < F.col("_p") + F.col("_c")))
    found = targets.where(~few).select(*gk, "_k", F.col("_lo").alias("_x")).unionByName(ranked.select(*gk, "_k", "_x"))
    by_rank = null_safe_join(found, ends.select(*gk, "_n"), gk)
    out = []
    for p, name in zip(probs, names):
        x = (F.col("_n") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("_k") == F.floor(x), F.col("_x")))
        high = F.max(F.when(F.col("_k") == F.least(F.floor(x) + 1, F.col("_n") - 1), F.col("_x")))
        part = F.max(x - F.floor(x))
        # an infinite neighbour that has no weight must not turn the value into NaN
        out.append(F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low)).alias(name))
    return by_rank.groupBy(*gk).agg(*out)


def _bin(bins: int) -> Column:
    """The bin of ``_x`` in [_lo, _hi]; infinite values and NaN (the largest) count as the ends of the doubles."""
    top = 1.7976931348623157e308
    low, high, x = (F.when(F.isnan(c), top / 2).otherwise(F.greatest(F.least(F.col(c), F.lit(top)), F.lit(-top)) / 2) for c in ("_lo", "_hi", "_x"))
    even = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when(high > low, even).otherwise(F.when(F.col("_x") >= F.col("_hi"), bins - 1).otherwise(0)).cast("int")


def _within(rows: DataFrame, spans: DataFrame, gk: Sequence[str]) -> DataFrame:
    """The rows inside the open intervals of their group; a row lies in as many as hold it."""
    keyed = list(gk)[:-1]
    return null_safe_join(rows, per_group(spans, keyed), gk).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))


def ordered_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_bucket: int = 200_000,
                    out: str = "_bk", tail: str | None = None) -> DataFrame:
    """Assign each row an ordered bucket id: ids increase with (keys, order).

    The frame is materialised, so that its rows have a lasting position, and
    ``repartitionByRange`` places them by (keys, order, position): balanced
    sampled bounds, binary search in the JVM. Rows with equal keys and order
    are cut by their position, so one bucket holds about ``rows_per_bucket``
    rows whatever the skew or the ties. The result is checkpointed (reliable),
    so every later use sees the same buckets. ``tail`` keeps the position as a column.
    """
    import math as _m
    from surveyspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    base = df.checkpoint(eager=True).withColumn(tail or "_pos", F.monotonically_increasing_id())
    nb = max(1, _m.ceil(base.count() / rows_per_bucket))
    cut = base.repartitionByRange(nb, *keys, *order, tail or "_pos").withColumn(out, F.spark_partition_id()).checkpoint(eager=True)
    return cut if tail else cut.drop("_pos")


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians of several columns: one row per key with one column per input column."""
    q = quantiles(long_form(df, cols, keys), [0.5], keys, names=["median"])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col(VAR) == x, F.col("median"))).alias(x) for x in cols])


def scalar_row(df: DataFrame) -> DataFrame:
    """Mark a one-row aggregate for broadcast (size 1 by construction)."""
    return F.broadcast(df)


def nz(col: Column, default=0.0) -> Column:
    return F.coalesce(col, F.lit(default))
