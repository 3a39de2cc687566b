import numpy as np
from pyspark.sql import functions as F

from surveyspark.operators import evaluate as EV


def _frame(spark, seed=0, n=400, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1)
    if ties:
        p = np.round(p, 1)       # many equal scores across both classes
    w = rng.integers(1, 5, n).astype(float)
    rows = [(int(a), float(b), float(c), i % 3) for i, (a, b, c) in enumerate(zip(y, p, w))]
    return spark.createDataFrame(rows, "y int, p double, w double, g int"), y, p, w


def _brute_auc(y, p, w):
    pos, neg = np.where(y == 1)[0], np.where(y == 0)[0]
    num = 0.0
    for i in pos:
        s = p[i] > p[neg]
        t = p[i] == p[neg]
        num += w[i] * (w[neg][s].sum() + 0.5 * w[neg][t].sum())
    return num / (w[pos].sum() * w[neg].sum())


def test_auc_matches_pairwise_brute_force(spark):
    df, y, p, w = _frame(spark)
    a = EV.weighted_auc(df, "y", "p", "w").first()["auc"]
    assert abs(a - _brute_auc(y, p, w)) < 1e-12


def test_auc_properties(spark):
    df, y, p, w = _frame(spark, ties=False)
    a = EV.weighted_auc(df, "y", "p", "w").first()["auc"]
    flip = EV.weighted_auc(df.withColumn("p", 1 - F.col("p")), "y", "p", "w").first()["auc"]
    mono = EV.weighted_auc(df.withColumn("p", F.exp(F.col("p") * 3)), "y", "p", "w").first()["auc"]
    assert abs(flip - (1 - a)) < 1e-12 and abs(mono - a) < 1e-12
    grouped = {r.g: r.auc for r in EV.weighted_auc(df, "y", "p", "w", ["g"]).collect()}
    assert len(grouped) == 3


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2, 1.0), (1, 0.8, 1.0)], "y int, p double, w double")
    assert EV.weighted_auc(df, "y", "p", "w").first()["auc"] is None


def test_log_loss_and_f1(spark):
    df, y, p, w = _frame(spark, ties=False)
    q = np.clip(p, 1e-15, 1 - 1e-15)
    ll = -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / w.sum()
    assert abs(EV.weighted_log_loss(df, "y", "p", "w").first()["log_loss"] - ll) < 1e-12
    yh = (p >= 0.5).astype(int)
    f1s = []
    for c in (0, 1):
        tp = w[(yh == c) & (y == c)].sum(); fp = w[(yh == c) & (y != c)].sum(); fn = w[(yh != c) & (y == c)].sum()
        f1s.append(2 * tp / (2 * tp + fp + fn))
    d = df.withColumn("yh", (F.col("p") >= 0.5).cast("int"))
    assert abs(EV.macro_f1(d, "y", "yh", "w").first()["f1_macro"] - np.mean(f1s)) < 1e-12
    mt = EV.metric_table(df, "y", "p", "w", []).first()
    assert abs(mt["f1_macro"] - np.mean(f1s)) < 1e-12 and abs(mt["log_loss"] - ll) < 1e-12


def test_roc_points_end_at_one(spark):
    df, *_ = _frame(spark)
    r = EV.roc_points(df, "y", "p", "w").orderBy(F.col("threshold").asc()).first()
    assert abs(r["tpr"] - 1.0) < 1e-12 and abs(r["fpr"] - 1.0) < 1e-12


def test_ordered_prefix_matches_cumsum(spark):
    vals = [(float(i), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(vals, "o double, v double").withColumn("k", F.lit(1))
    out = {r.o: r.cum_v for r in EV.ordered_prefix(df, ["k"], "o", ["v"], rows_per_bucket=40).collect()}
    run = 0.0
    for o, v in vals:
        assert out[o] == run
        run += v
