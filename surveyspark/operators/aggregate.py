"""Aggregations, windows, ordering and set operators (AGG-1, 5-13, 17, 18, WIN-1, WIN-4, TOP-*, SET-1).

All aggregates are declarative ``groupBy().agg()`` plans: Spark combines
map-side, so a hot group key costs one partial row per task, not a hot task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shape_log(df: DataFrame, stage: str) -> DataFrame:
    """AGG-1: (stage, n_rows, n_cols) of a DataFrame at a pipeline stage."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(stage).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))


class StageCounts:
    """AGG-1 while a plan runs: ``watch(stage, frame)`` observes the frame; no job of its own counts anything.

    The frames must come from ``watch.spark``, a session of the watch's own: a session that has observed once holds a manager
    that can't be serialised, and can no longer checkpoint plans with scalar subqueries. After the plan's action
    ``table`` gives (stage, n_rows, n_cols) in the order of the stages.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        self.seen: list = []

    def __call__(self, stage: str, df: DataFrame) -> DataFrame:
        if df.sparkSession is not self.spark:
            raise ValueError("the frame is not of the watch's session")
        observed = Observation()
        self.seen.append((stage, observed, len(df.columns)))
        return df.observe(observed, F.count(F.lit(1)).alias("n_rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, o.get["n_rows"], n) for s, o, n in self.seen], "stage string, n_rows long, n_cols int")


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """AGG-5: distinct count per column, long form (variable, n_distinct)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(*[fn(F.col(x)).alias(x) for x in cols])
    return wide.unpivot([], list(cols), "variable", "n_distinct").select(
        "variable", F.col("n_distinct").cast("long").alias("n_distinct"))


def cluster_counts(df: DataFrame, split: str, cluster: str) -> DataFrame:
    """AGG-6: rows and distinct clusters per partition."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_distinct(cluster).alias("n_clusters"))


def weighted_mean(y, w) -> Column:
    """AGG-7: sum(w * y) / sum(w)."""
    y, w = _c(y), _c(w)
    return F.try_divide(F.sum(w * y), F.sum(w))


def prevalence(y) -> Column:
    """AGG-8: plain mean of a 0/1 indicator."""
    return F.avg(_c(y))


def conditional_rates(df: DataFrame, composite: str, subs: Sequence[str],
                      names: Sequence[str] | None = None) -> DataFrame:
    """AGG-9: P(sub = 1 | composite = 1), unweighted; one row."""
    names = names or [f"p_{s}_given_{composite}" for s in subs]
    return df.where(F.col(composite) == 1).agg(*[F.avg(F.col(s).cast("double")).alias(n)
                                                 for s, n in zip(subs, names)])


def by_group(df: DataFrame, key: str | Sequence[str], y: str, score: str, w: str | None = None) -> DataFrame:
    """AGG-10: per-group total, alerts, mean score, alert rate (and weighted rate)."""
    keys = [key] if isinstance(key, str) else list(key)
    aggs = [F.count(F.lit(1)).alias("total"),
            F.sum(F.col(y)).cast("long").alias("alerts"),
            F.avg(score).alias("mean_score"),
            F.avg(F.col(y).cast("double")).alias("alert_rate")]
    if w:
        aggs.append(weighted_mean(F.col(y), F.col(w)).alias("weighted_rate"))
    return df.groupBy(*keys).agg(*aggs)


def batch_kpis(df: DataFrame, y: str, score: str) -> DataFrame:
    """AGG-11 / AGG-18: total, alerts, normal, alert rate, mean score; one row."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.col(y)).cast("long").alias("alerts"),
                  F.sum(1 - F.col(y)).cast("long").alias("normal"),
                  F.avg(F.col(y).cast("double")).alias("alert_rate"),
                  F.avg(score).alias("mean_score"))


def session_kpis(df: DataFrame, session: str, y: str, score: str) -> DataFrame:
    """AGG-12: batch KPIs per session."""
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("total"),
                                   F.sum(F.col(y)).cast("long").alias("alerts"),
                                   F.avg(F.col(y).cast("double")).alias("alert_rate"),
                                   F.avg(score).alias("mean_score"))


def subclass_summary(df: DataFrame, pairs: dict) -> DataFrame:
    """AGG-13: per sub-class mean probability and count above its cut-off.

    ``pairs`` maps sub-class name -> (probability column, cut-off). Stacked to
    long form so all sub-classes aggregate in one pass.
    """
    arr = F.array(*[F.struct(F.lit(k).alias("subclass"), F.col(c).cast("double").alias("prob"),
                             F.lit(float(t)).alias("cut")) for k, (c, t) in pairs.items()])
    long = df.select(F.explode(arr).alias("s")).select("s.*")
    return long.groupBy("subclass").agg(F.avg("prob").alias("mean_prob"),
                                        F.count_if(F.col("prob") >= F.col("cut")).alias("n_above"))


def share(df: DataFrame, y: str) -> DataFrame:
    """AGG-18: two-part split (risk / normal) with shares."""
    tot = df.groupBy(F.when(F.col(y) == 1, "risk").otherwise("normal").alias("part")).agg(
        F.count(F.lit(1)).alias("n"))
    return share_of_total(tot, "n", [], out="share").withColumn("share", F.col("share") / 100.0)


def column_widths(df: DataFrame, cols: Sequence[str] | None = None, pad: int = 3, cap: int = 65) -> DataFrame:
    """AGG-17: display width per column: min(max(text length, name length) + pad, cap)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.max(F.length(F.col(x).cast("string"))).alias(x) for x in cols])
    long = wide.unpivot([], cols, "variable", "max_len")
    name_len = F.length("variable")
    return long.select("variable", F.least(F.greatest(F.coalesce("max_len", F.lit(0)), name_len) + pad,
                                           F.lit(cap)).alias("width"))


def sequence(df: DataFrame, session: str, order: Sequence[str], out: str = "seq",
             hot_rows: int = 100_000) -> DataFrame:
    """WIN-1: 1..n inside each session, ordered by ``order`` (nulls first; a null session is a session).

    Equivalent to ``row_number() over (partition by session order by ...)``.
    Rows are cut into ordered ranges of (session, order, position) of about
    ``hot_rows`` rows, each range numbers its own rows and the ranges' counts
    are prefix-summed per session. The plan is the same at every size, and no
    task sorts a whole hot session: rows that share session and order are cut
    by their position in the materialised input, which also orders them.
    """
    from surveyspark.operators.joins import null_safe_join
    from surveyspark.operators.stats_core import ordered_buckets
    b = ordered_buckets(df, [session], order, rows_per_bucket=hot_rows, tail="_pos")
    cnt = b.groupBy(session, "_bk").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(session).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    wi = Window.partitionBy(session, "_bk").orderBy(*order, "_pos")
    return (null_safe_join(b, off, [session, "_bk"])
            .withColumn(out, (F.col("_off") + F.row_number().over(wi)).cast("long")).drop("_bk", "_off", "_pos"))


def share_of_total(df: DataFrame, n: str, by: Sequence[str], out: str = "pct") -> DataFrame:
    """WIN-4: percentage of the group total.

    The group totals are a grouped aggregate joined back, so no window ever
    holds a whole large group in one task.
    """
    by = list(by)
    if not by:
        tot = df.agg(F.sum(n).alias("__tot"))
        from surveyspark.operators.joins import with_scalars
        j = with_scalars(df, tot)
    else:
        from surveyspark.operators.joins import null_safe_join
        j = null_safe_join(df, df.groupBy(*by).agg(F.sum(n).alias("__tot")), by)
    return j.withColumn(out, F.col(n) * 100.0 / F.col("__tot")).drop("__tot")


def ordered(df: DataFrame, order: Sequence) -> DataFrame:
    """TOP-5: frequency-descending / rate-ascending order with an explicit tie-break (range-partitioned sort)."""
    return df.orderBy(*order)


def best_model(metrics: DataFrame, col: str, ordinal: str = "ordinal") -> DataFrame:
    """TOP-1: the row with the largest metric; the first (lowest ordinal) wins ties."""
    return metrics.orderBy(F.col(col).desc(), F.col(ordinal).asc()).limit(1)


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """TOP-2 / TOP-4: k rows by descending ``col`` with a deterministic tie-break (TakeOrdered)."""
    return df.orderBy(F.col(col).desc(), F.col(tie).asc()).limit(k)


def preview(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """TOP-4: first n rows under an explicit order key."""
    return df.orderBy(*order).limit(n)


def top_in_row(names: Sequence[str], values: Sequence, k: int) -> Column:
    """TOP-3 / TOP-6: the k largest (name, value) pairs inside each row, stable on ties.

    ``sort_array`` over structs (negated value, input position, name) orders by
    descending value then input order, with codegen-friendly natural ordering
    (no interpreted comparator lambda).
    """
    arr = F.array(*[F.struct((-_c(v).cast("double")).alias("neg"), F.lit(i).alias("ord"), F.lit(nm).alias("name"))
                    for i, (nm, v) in enumerate(zip(names, values))])
    top = F.slice(F.sort_array(arr), 1, k)
    return F.transform(top, lambda x: F.struct(x["name"].alias("name"), (-x["neg"]).alias("value"),
                                               x["ord"].alias("ord")))


def stack_metrics(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-1: stack per-model / per-partition metric frames by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
