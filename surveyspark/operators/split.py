"""Sampling, splitting and folds (SPL-*), all keyed on seeded md5 hashes.

Random choices rank keys by ``md5(seed ':' key)`` (identical in Spark and
DuckDB). Global ranks are computed without a single-task window: the leading
hex digits of the hash are uniform, so they cut the key space into equal
buckets; bucket counts are prefix-summed (a small table) and each bucket ranks
its own keys.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.operators.joins import null_safe_join, with_scalars


def seeded_hash(seed, key) -> Column:
    """md5 hex of 'seed:key' (string)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))


def unit_hash(seed, key) -> Column:
    """Uniform [0, 1) from the first 8 hex digits of the seeded md5."""
    return F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("long") / 4294967296.0


def hash_rank(df: DataFrame, h: str | Column, partition: Sequence[str] = (), digits: int = 4,
              out: str = "rank", tie: Sequence[str] = ()) -> DataFrame:
    """1-based rank of rows by the hex-hash column ``h`` within ``partition``.

    Equivalent to ``row_number() over (partition by .. order by h)`` but the
    window runs per (partition, hash-prefix bucket): 16**digits buckets keep
    every window task small even when one partition holds a third of the rows.
    The buckets' offsets are checkpointed and broadcast within a checked bound,
    so whole rows are shuffled once; the sort begins with the bucket, which
    tells most rows apart, not with a class that half of them share. A hash given as
    an expression is not shuffled: only the bucket travels, and the hash is computed where it is sorted.
    """
    from surveyspark.functions.exprs import materialize_small
    part = list(partition)
    b = df.withColumn("_bk", F.substring(F.col(h) if isinstance(h, str) else h, 1, digits))
    cnt = b.groupBy(*part, "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = materialize_small(cnt.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn"), 1_000_000)
    if not isinstance(h, str):
        b, h = b.repartition("_bk", *part).withColumn("_hx", h), "_hx"
    wi = Window.partitionBy("_bk", *part).orderBy(h, *tie)
    ranked = b.withColumn("_in", F.row_number().over(wi)).drop("_hx")
    return null_safe_join(ranked, off, [*part, "_bk"]).withColumn(out, F.col("_off") + F.col("_in")).drop("_bk", "_off", "_in")


def group_split(df: DataFrame, key: str, fraction: float, seed, name: str = "test",
                rest: str = "train") -> DataFrame:
    """SPL-1: cluster-disjoint split table (key, split).

    ``ceil(fraction * G)`` clusters (G distinct clusters) with the smallest
    seeded hash go to ``name``; the others to ``rest``.
    """
    keys = df.select(key).distinct().withColumn("_h", seeded_hash(seed, key))
    g = keys.agg(F.count(F.lit(1)).alias("_G"))
    ranked = hash_rank(keys, "_h", out="_r")
    j = with_scalars(ranked, g)
    k = F.ceil(F.lit(float(fraction)) * F.col("_G"))
    return j.select(key, F.when(F.col("_r") <= k, F.lit(name)).otherwise(F.lit(rest)).alias("split"))


def three_way_split(df: DataFrame, key: str, stress: float = 0.15, test: float = 0.20,
                    seeds=(2018, 42)) -> DataFrame:
    """SPL-2: stress share of clusters first, then the test share of the remaining clusters."""
    s1 = group_split(df, key, stress, seeds[0], "stress", "rest")
    rest = s1.where(F.col("split") == "rest").select(key)
    s2 = group_split(rest, key, test, seeds[1], "test", "train")
    return s1.where(F.col("split") == "stress").unionByName(s2)


def group_kfold(df: DataFrame, key: str, k: int = 3, seed=0, out: str = "fold") -> DataFrame:
    """SPL-3: size-balanced group folds (key, fold); clusters stay intact.

    Clusters are ranked by size (descending; ties by seeded hash) and dealt in
    serpentine order 0..k-1, k-1..0, ... The rank is taken per size value:
    there are at most sqrt(2N) distinct sizes, so the size-level prefix is small.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", seeded_hash(seed, key))
    per_size = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    ws = Window.orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    off = per_size.withColumn("_off", F.coalesce(F.sum("_c").over(ws), F.lit(0))).drop("_c")
    r = hash_rank(sizes, "_h", ["_n"], digits=3, out="_rin").join(off, "_n")
    r0 = F.col("_off") + F.col("_rin") - 1
    blk, pos = F.floor(r0 / k), r0 % k
    fold = F.when(blk % 2 == 0, pos).otherwise(k - 1 - pos).cast("int")
    return r.select(key, fold.alias(out))


def stratified_kfold(df: DataFrame, y: str, row_key: Sequence[str] | str, k: int = 3, seed=0,
                     out: str = "fold") -> DataFrame:
    """SPL-4: stratified folds: hash rank within each class, modulo k."""
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    h = seeded_hash(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    r = hash_rank(df, h, [y], out="_r")
    return r.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def sample_n(df: DataFrame, n: int, seed, key: Sequence[str] | str, by: Sequence[str] = (),
             digits: int = 4) -> DataFrame:
    """SPL-5: the ``n`` rows with the smallest seeded hash (per ``by`` group).

    Bucket counts locate, per group, the last hash bucket needed to reach n
    rows; only rows up to that bucket are ranked, so the window work is about
    n + N / 16**digits rows per group instead of the whole group. Rows with
    equal keys are ordered by a hash of the whole row.
    """
    from surveyspark.functions.exprs import materialize_small
    from surveyspark.session import staged
    keys = [key] if isinstance(key, str) else list(key)
    by = list(by)
    h = seeded_hash(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    b = df.withColumn("_t", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn("_h", h).withColumn("_bk", F.substring("_h", 1, digits))
    cnt = b.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    need = (cnt.withColumn("_before", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
            .where(F.col("_before") < n).select(*by, "_bk"))
    # few buckets are needed: broadcast, they filter the rows where they lie, and only the rows kept are ranked
    kept = staged(null_safe_join(b, materialize_small(need, 1_000_000), [*by, "_bk"], "left_semi").drop("_bk"), "sample")
    r = hash_rank(kept, "_h", by, digits=digits, out="_r", tie=["_t"])
    return r.where(F.col("_r") <= n).drop("_h", "_r", "_t")


def fraction_ladder(df: DataFrame, sizes: Sequence[float], seed, key: Sequence[str] | str,
                    out: str = "size") -> DataFrame:
    """SPL-6: nested training subsets: each row joins every size > its hash-uniform u.

    Returns the rows exploded once per size they belong to; subsets nest by
    construction (u < 0.2 implies u < 0.4 ...).
    """
    keys = [key] if isinstance(key, str) else list(key)
    u = unit_hash(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    arr = F.array(*[F.lit(float(s)) for s in sizes])
    return (df.withColumn("_u", u)
            .withColumn(out, F.explode(F.filter(arr, lambda s: F.col("_u") < s)))
            .drop("_u"))


def ceil_count(fraction: float, g: int) -> int:
    return int(math.ceil(fraction * g))
