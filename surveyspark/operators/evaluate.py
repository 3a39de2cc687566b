"""Weighted evaluation metrics (EVL-*, WIN-2), all grouped by any key list.

Metrics for many models / partitions come out of one grouped pass each. The
rank-based ones (AUC, ROC) first collapse rows to distinct scores per group
and then take running sums over score order with an ordered-bucket prefix
sum, so no single task ever sorts a whole group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.operators.joins import null_safe_join, with_scalars

_ONE = "__grp"


def _keys(df: DataFrame, by: Sequence[str]):
    by = list(by)
    if by:
        return df, by
    return df.withColumn(_ONE, F.lit(1)), [_ONE]


def ordered_prefix(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str],
                   rows_per_bucket: int = 200_000, prefix: str = "cum_") -> DataFrame:
    """Exclusive running sums of ``cols`` over ascending ``order`` within ``by`` (distinct order values).

    Rows get ordered bucket ids from a range partitioning (``stats_core.ordered_buckets``,
    checkpointed); bucket totals are prefix-summed per group over a small table,
    and each bucket runs its own window, so no group is sorted in one task.
    """
    from surveyspark.operators.stats_core import ordered_buckets
    gk = list(by)
    b = ordered_buckets(df, gk, [order], rows_per_bucket=rows_per_bucket)
    btot = b.groupBy(*gk, "_bk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in cols])
    wb = Window.partitionBy(*gk).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    boff = btot.select(*gk, "_bk", *[F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0.0)).alias(f"_bo_{c}")
                                     for c in cols])
    wi = Window.partitionBy(*gk, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    j = null_safe_join(b, boff, [*gk, "_bk"])
    return j.select(*[x for x in b.columns if x != "_bk"],
                    *[(F.col(f"_bo_{c}") + F.coalesce(F.sum(c).over(wi), F.lit(0.0))).alias(f"{prefix}{c}")
                      for c in cols])


def score_table(df: DataFrame, y: str, p: str, w: str | None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores per group with positive / negative weight (wp, wn)."""
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    return df.groupBy(*by, F.col(p).alias("_s")).agg(
        F.sum(F.when(F.col(y) == 1, wcol).otherwise(0.0)).alias("wp"),
        F.sum(F.when(F.col(y) == 1, 0.0).otherwise(wcol)).alias("wn"))


def score_ranges(table: DataFrame, score: str, rows_per_range: int = 200_000, most: int = 5000, out: str = "_bk") -> DataFrame:
    """Ordered range ids of a score column: nulls first, NaN last, equal scores in one range."""
    from pyspark.ml.feature import Bucketizer
    k = min(most, table.count() // rows_per_range + 1)
    cuts = []
    if k > 1:
        number = F.when(~F.isnan(score), F.col(score))
        cuts = table.agg(F.percentile_approx(number, [i / k for i in range(1, k)], 4 * most).alias("c")).first()["c"] or []
    inside = sorted({c for c in cuts if abs(c) != float("inf")})
    if not inside:
        return table.withColumn(out, F.when(F.col(score).isNull(), -1).when(F.isnan(score), 1).otherwise(0))
    ids = Bucketizer(splits=[-float("inf"), *inside, float("inf")], inputCol=score, outputCol=out, handleInvalid="keep").transform(table)
    return ids.withColumn(out, F.when(F.col(score).isNull(), F.lit(-1)).otherwise(F.col(out).cast("int")))


def weighted_auc(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (),
                 out: str = "auc") -> DataFrame:
    """EVL-1: tie-aware weighted ROC AUC per group.

    AUC = sum over scores of wp * (weight of negatives with a lower score +
    half the negatives tied) / (total wp * total wn). Null when one class is absent.
    The distinct scores are staged by column and cut into ranges at their approximate
    quantiles (any cuts give the same sum). Each range adds up its own pairs; what the
    lower ranges hold comes from a running sum over the small table of ranges.
    """
    from surveyspark.session import staged
    d, gk = _keys(df, by)
    res = auc_of_scores(staged(score_table(d, y, p, w, gk), "scores"), gk, out)
    return res.drop(_ONE) if not by else res


def auc_of_scores(table: DataFrame, gk: Sequence[str], out: str = "auc") -> DataFrame:
    """:func:`weighted_auc` from a staged :func:`score_table`."""
    st = score_ranges(table, "_s")
    wi = Window.partitionBy(*gk, "_bk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.col("wp") * (F.coalesce(F.sum("wn").over(wi), F.lit(0.0)) + F.col("wn") / 2.0)
    ranges = st.select(*gk, "_bk", "wp", "wn", inner.alias("_in")).groupBy(*gk, "_bk").agg(
        F.sum("_in").alias("_in"), F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))
    wb = Window.partitionBy(*gk).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_below", F.coalesce(F.sum("wn").over(wb), F.lit(0.0)))
    res = ranges.groupBy(*gk).agg(
        F.sum(F.col("_in") + F.col("wp") * F.col("_below")).alias("_num"),
        F.sum("wp").alias("_tp"), F.sum("wn").alias("_tn"))
    return res.select(*gk, F.try_divide(F.col("_num"), F.col("_tp") * F.col("_tn")).alias(out))


def roc_points(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """EVL-7 / WIN-2: (threshold, fpr, tpr) at every distinct score, thresholds descending."""
    d, gk = _keys(df, by)
    st = ordered_prefix(score_table(d, y, p, w, gk), gk, "_s", ["wp", "wn"])
    tot = st.groupBy(*gk).agg(F.sum("wp").alias("_TP"), F.sum("wn").alias("_TN"))
    j = null_safe_join(st, tot, gk)
    tp_at = F.col("_TP") - F.col("cum_wp")
    fp_at = F.col("_TN") - F.col("cum_wn")
    res = j.select(*gk, F.col("_s").alias("threshold"), F.try_divide(fp_at, F.col("_TN")).alias("fpr"),
                   F.try_divide(tp_at, F.col("_TP")).alias("tpr"))
    return res.drop(_ONE) if not by else res


def weighted_log_loss(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (),
                      eps: float = 1e-15, out: str = "log_loss") -> DataFrame:
    """EVL-2: weighted binary log loss with probabilities clipped to [eps, 1 - eps]."""
    q = F.greatest(F.least(F.col(p), F.lit(1.0 - eps)), F.lit(eps))
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    yy = F.col(y).cast("double")
    ll = -(yy * F.ln(q) + (1.0 - yy) * F.ln(1.0 - q))
    return df.groupBy(*by).agg((F.sum(wcol * ll) / F.sum(wcol)).alias(out))


def _confusion_sums(df: DataFrame, y: str, yhat: str, w: str | None, by: Sequence[str]) -> DataFrame:
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    yc, hc = F.col(y), F.col(yhat)
    return df.groupBy(*by).agg(
        F.sum(F.when((yc == 1) & (hc == 1), wcol).otherwise(0.0)).alias("tp"),
        F.sum(F.when((yc == 0) & (hc == 1), wcol).otherwise(0.0)).alias("fp"),
        F.sum(F.when((yc == 1) & (hc == 0), wcol).otherwise(0.0)).alias("fn"),
        F.sum(F.when((yc == 0) & (hc == 0), wcol).otherwise(0.0)).alias("tn"),
        F.max(F.when(yc == 1, 1).otherwise(0)).alias("_has1"),
        F.max(F.when(yc == 0, 1).otherwise(0)).alias("_has0"),
        F.max(F.when(hc == 1, 1).otherwise(0)).alias("_hhas1"),
        F.max(F.when(hc == 0, 1).otherwise(0)).alias("_hhas0"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 = 2 tp / (2 tp + fp + fn); zero division -> 0."""
    den = 2.0 * tp + fp + fn
    return F.when(den > 0, 2.0 * tp / den).otherwise(F.lit(0.0))


def _zdiv(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def macro_f1(df: DataFrame, y: str, yhat: str, w: str | None = None, by: Sequence[str] = (),
             out: str = "f1_macro") -> DataFrame:
    """EVL-3: weighted macro F1 over the classes present in y or yhat (binary 0/1)."""
    s = _confusion_sums(df, y, yhat, w, by)
    f1_pos = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    f1_neg = _f1(F.col("tn"), F.col("fn"), F.col("fp"))
    present1 = ((F.col("_has1") + F.col("_hhas1")) > 0).cast("double")
    present0 = ((F.col("_has0") + F.col("_hhas0")) > 0).cast("double")
    return s.select(*by, ((f1_pos * present1 + f1_neg * present0) / (present1 + present0)).alias(out))


def accuracy_precision_recall(df: DataFrame, y: str, yhat: str, w: str | None = None,
                              by: Sequence[str] = ()) -> DataFrame:
    """EVL-4: weighted accuracy, precision, recall (positive class 1); zero division -> 0."""
    s = _confusion_sums(df, y, yhat, w, by)
    tot = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return s.select(*by, _zdiv(F.col("tp") + F.col("tn"), tot).alias("accuracy"),
                    _zdiv(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _zdiv(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def classification_report(df: DataFrame, y: str, yhat: str, p: str, w: str | None = None) -> DataFrame:
    """EVL-5: rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' x (precision, recall, f1, support),
    with AUC and log loss repeated on every row; the accuracy row carries accuracy in every metric column."""
    s = _confusion_sums(df, y, yhat, w, [])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _zdiv(tp, tp + fp), _zdiv(tp, tp + fn)
    p0, r0 = _zdiv(tn, tn + fn), _zdiv(tn, tn + fp)
    f1_1, f1_0 = _f1(tp, fp, fn), _f1(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    acc = _zdiv(tp + tn, tp + fp + fn + tn)
    tot = s1 + s0
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f1_0.alias("f1"),
                 s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1_1.alias("f1"),
                 s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), acc.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f1_0 + f1_1) / 2).alias("f1"), tot.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), _zdiv(p0 * s0 + p1 * s1, tot).alias("precision"),
                 _zdiv(r0 * s0 + r1 * s1, tot).alias("recall"), _zdiv(f1_0 * s0 + f1_1 * s1, tot).alias("f1"),
                 tot.alias("support")))
    rep = s.select(F.explode(rows).alias("r")).select("r.*")
    auc = weighted_auc(df, y, p, w)
    ll = weighted_log_loss(df, y, p, w)
    return with_scalars(with_scalars(rep, auc), ll)


def confusion(df: DataFrame, y: str, yhat: str, w: str | None = None, normalise: bool = True,
              by: Sequence[str] = ()) -> DataFrame:
    """EVL-6: weighted confusion matrix (y, yhat, weight[, share of the true-class row])."""
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    c = df.groupBy(*by, y, yhat).agg(F.sum(wcol).alias("weight"))
    if not normalise:
        return c
    rows = c.groupBy(*by, y).agg(F.sum("weight").alias("_row"))
    return null_safe_join(c, rows, [*by, y]).withColumn("share", F.col("weight") / F.col("_row")).drop("_row")


def metric_table(df: DataFrame, y: str, p: str, w: str | None, by: Sequence[str], cutoff: float = 0.5,
                 eps: float = 1e-15) -> DataFrame:
    """AUC, log loss and macro F1 per group (one row per group).

    The columns it needs are staged, so rows are scored once. Two grouped passes over
    them: the distinct-score table for AUC, and one aggregate that carries both the
    log-loss sums and the confusion sums.
    """
    from surveyspark.session import staged
    df = staged(df.select(*dict.fromkeys([*by, y, p, *([w] if w else [])])), "scored")
    wcol = F.col(w).cast("double") if w else F.lit(1.0)
    yc, hc = F.col(y), (F.col(p) >= cutoff).cast("int")
    yy = yc.cast("double")
    q = F.greatest(F.least(F.col(p), F.lit(1.0 - eps)), F.lit(eps))
    s = df.groupBy(*by).agg(
        F.sum(wcol * -(yy * F.ln(q) + (1.0 - yy) * F.ln(1.0 - q))).alias("_ll"), F.sum(wcol).alias("_w"),
        F.sum(F.when((yc == 1) & (hc == 1), wcol).otherwise(0.0)).alias("tp"),
        F.sum(F.when((yc == 0) & (hc == 1), wcol).otherwise(0.0)).alias("fp"),
        F.sum(F.when((yc == 1) & (hc == 0), wcol).otherwise(0.0)).alias("fn"),
        F.sum(F.when((yc == 0) & (hc == 0), wcol).otherwise(0.0)).alias("tn"),
        F.max(F.when(yc == 1, 1).otherwise(0)).alias("_has1"), F.max(F.when(yc == 0, 1).otherwise(0)).alias("_has0"),
        F.max(F.when(hc == 1, 1).otherwise(0)).alias("_hhas1"), F.max(F.when(hc == 0, 1).otherwise(0)).alias("_hhas0"))
    f1_pos = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    f1_neg = _f1(F.col("tn"), F.col("fn"), F.col("fp"))
    present1 = ((F.col("_has1") + F.col("_hhas1")) > 0).cast("double")
    present0 = ((F.col("_has0") + F.col("_hhas0")) > 0).cast("double")
    rest = s.select(*by, (F.col("_ll") / F.col("_w")).alias("log_loss"),
                    ((f1_pos * present1 + f1_neg * present0) / (present1 + present0)).alias("f1_macro"))
    auc = weighted_auc(df, y, p, w, by)
    return null_safe_join(auc, rest, by) if by else with_scalars(auc, rest)


def gap_table(scored: DataFrame, y: str, p: str, w: str | None, model: str = "model", split: str = "split",
              train: str = "train", test: str = "test", rule: str = "four_band") -> DataFrame:
    """EVL-8: per model: train / test AUC, log loss, F1, AUC gap and its verdict."""
    from surveyspark.operators.derive import gap_verdict
    m = metric_table(scored.where(F.col(split).isin(train, test)), y, p, w, [model, split])
    piv = m.groupBy(model).agg(*[F.max(F.when(F.col(split) == s, F.col(c))).alias(f"{c}_{s}")
                                 for s in (train, test) for c in ("auc", "log_loss", "f1_macro")])
    gap = F.col(f"auc_{train}") - F.col(f"auc_{test}")
    return piv.withColumn("delta_auc", gap).withColumn("diagnostic", gap_verdict(gap, rule))


def partition_table(scored: DataFrame, y: str, p: str, w: str | None, split: str = "split",
                    train: str = "train") -> DataFrame:
    """EVL-9: per partition AUC, log loss, F1 and the AUC gap versus the training partition."""
    m = metric_table(scored, y, p, w, [split])
    tr = m.where(F.col(split) == train).select(F.col("auc").alias("_auc_train"))
    return with_scalars(m, tr).withColumn("gap_vs_train", F.col("_auc_train") - F.col("auc")).drop("_auc_train")


def subclass_accuracy(df: DataFrame, pairs: dict, w: str | None = None) -> DataFrame:
    """EVL-10: per sub-class accuracy / precision / recall with a median cut of its probability.

    ``pairs`` maps name -> (probability column, true 0/1 column). Stacked to
    long form; the medians are exact per sub-class (DRV-10).
    """
    from surveyspark.operators import stats_core as S
    arr = F.array(*[F.struct(F.lit(k).alias("subclass"), F.col(pc).cast("double").alias("prob"),
                             F.col(yc).cast("int").alias("truth"),
                             (F.col(w).cast("double") if w else F.lit(1.0)).alias("wt"))
                    for k, (pc, yc) in pairs.items()])
    long = df.select(F.explode(arr).alias("s")).select("s.*")
    # one row per sub-class: the sub-class is the variable
    med = S.quantiles(long.select(F.col("subclass").alias("variable"), F.col("prob").alias("value")), [0.5],
                      names=["median"]).withColumnRenamed("variable", "subclass")
    j = long.join(F.broadcast(med), "subclass").withColumn("pred", (F.col("prob") >= F.col("median")).cast("int"))
    return accuracy_precision_recall(j, "truth", "pred", "wt", ["subclass"])


def permuted_pairs(df: DataFrame, features: Sequence[str], keep: Sequence[str], row_key: Sequence[str], repeats: int,
                   seed: int) -> DataFrame:
    """(repeat, keep..., features..., _donor): every row with the features of the row whose values it takes in that repeat.

    A repeat ranks the rows by one seeded hash of their key and the donors by another; equal ranks are
    paired. The pairing is the same for all features, so rows are ranked once per repeat, not per feature.
    """
    from surveyspark.operators.split import hash_rank, seeded_hash
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    ex = df.select(*dict.fromkeys([*keep, *features]), key.alias("_rk"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))

    def order(name):
        return seeded_hash(f"{seed}:{name}", F.concat_ws(":", F.col("repeat").cast("string"), F.col("_rk")))

    own = hash_rank(ex.withColumn("_h", order("own")), "_h", ["repeat"], out="_r").drop("_h", "_rk")
    donor = hash_rank(ex.select("repeat", F.struct(*features).alias("_donor"), order("donor").alias("_h")), "_h", ["repeat"], out="_r").drop("_h")
    return own.join(donor, ["repeat", "_r"]).drop("_r")


def permutation_importance(df: DataFrame, features: Sequence[str], score_fn, y: str, row_key: Sequence[str],
                           repeats: int = 10, seed: int = 0, w: str | None = None, at_once: int = 4) -> DataFrame:
    """EVL-11: mean and sd of the AUC drop when one feature is permuted; all features share one pairing of rows.

    ``score_fn(frame)`` returns a probability column of the frame, or the frame
    with a ``prob`` column (a fitted model). The pairing is staged once;
    ``at_once`` features are scored in one pass over it, the others after them.
    """
    from surveyspark.session import staged
    keep = [y, *([w] if w else [])]

    def scored(frame):
        out = score_fn(frame)
        return out.withColumn("_p", F.col("prob")) if isinstance(out, DataFrame) else frame.withColumn("_p", out)

    base_auc = weighted_auc(scored(df.select(*dict.fromkeys([*keep, *features]))), y, "_p", w).select(F.col("auc").alias("_base"))
    pairs = staged(permuted_pairs(df, features, keep, row_key, repeats, seed), "pairs")
    aucs = None
    for i in range(0, len(features), at_once):
        some = features[i:i + at_once]
        ex = pairs.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in some])))
        ex = ex.withColumns({f: F.when(F.col("feature") == f, F.col("_donor")[f]).otherwise(F.col(f)) for f in some}).drop("_donor")
        part = weighted_auc(scored(ex).select("feature", "repeat", *keep, "_p"), y, "_p", w, ["feature", "repeat"])
        aucs = part if aucs is None else aucs.unionByName(part)
    drops = with_scalars(aucs, base_auc).withColumn("drop", F.col("_base") - F.col("auc"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                        F.stddev_pop("drop").alias("importance_sd"))
