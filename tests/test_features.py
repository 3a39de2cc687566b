import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from surveyspark.operators import features as FE


def _enc_manual(tr, cat, y):
    ym, yv = tr[y].mean(), tr[y].var(ddof=0)
    out = {}
    for c, g in tr.groupby(cat):
        n, m, v = len(g), g[y].mean(), g[y].var(ddof=0)
        lam = n * yv / (n * yv + v)
        out[c] = lam * m + (1 - lam) * ym
    return out, ym


def test_target_encoding_cross_fit(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"cat": rng.integers(0, 5, n), "y": rng.integers(0, 2, n), "fold": rng.integers(0, 3, n),
                        "split": np.where(rng.random(n) < 0.7, "train", "test")})
    pdf.loc[0, ["cat", "split"]] = [99, "test"]               # unseen level
    df = spark.createDataFrame(pdf)
    out = FE.target_encode(df, ["cat"], "y").toPandas()
    tr = pdf[pdf.split == "train"]
    full, ym = _enc_manual(tr, "cat", "y")
    for _, r in out.iterrows():
        if r["split"] == "train":
            oof, oym = _enc_manual(tr[tr.fold != r["fold"]], "cat", "y")
            exp = oof.get(r["cat"], oym)      # encoder never sees its own fold
        else:
            exp = full.get(r["cat"], ym)
        assert abs(r["cat_te"] - exp) < 1e-9


def test_standardiser_population_sd(spark):
    df = spark.createDataFrame([(1.0, "train"), (2.0, "train"), (3.0, "train"), (10.0, "test")], "x double, split string")
    p = FE.fit_standardiser(df.where(F.col("split") == "train"), ["x"])
    out = [r.x for r in FE.apply_standardiser(df, p, ["x"]).orderBy("x").collect()]
    sd = np.std([1, 2, 3])
    assert abs(out[0] - (-1 / sd)) < 1e-12 and abs(out[3] - (8 / sd)) < 1e-12


def test_balance_weights_equalise_classes(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 1.0), (0, 3.0), (0, 4.0)], "y int, w double")
    b = FE.balance_weights(df, "y", "w")
    t = {r.y: r.s for r in b.groupBy("y").agg(F.sum("w_balanced").alias("s")).collect()}
    assert abs(t[0] - t[1]) < 1e-9


def test_design_matrix_treatment_coding(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "a int, f int")
    dm, terms = FE.design_matrix(df, ["a"], ["f"])
    assert terms == ["Intercept", "a", "C(f)[T.2]", "C(f)[T.3]"]


def test_formula_design_learns_its_levels_in_training(spark):
    import pytest
    train = spark.createDataFrame([(1, 2, 10, "u"), (0, 3, 2, "v"), (1, 4, 7, "u"), (0, None, 7, "v"), (1, 5, 2, "v")], "y int, a int, f int, g string")
    d = FE.fit_design(train, "y ~ a + C(f) + C(g)")
    assert d.terms == ["Intercept", "a", "C(f)[T.10]", "C(f)[T.7]", "C(g)[T.v]"] and d.label == "y"
    rows = {r.a: r for r in d.columns(train).collect()}
    assert len(rows) == 4 and (rows[2]["C(f)[T.10]"], rows[2]["C(f)[T.7]"], rows[2]["C(g)[T.v]"]) == (1.0, 0.0, 0.0)
    assert (rows[3]["C(f)[T.10]"], rows[3]["C(f)[T.7]"], rows[3]["C(g)[T.v]"], rows[3]["Intercept"]) == (0.0, 0.0, 1.0, 1.0)
    with pytest.raises(Exception, match="[Uu]nseen"):
        d.transform(spark.createDataFrame([(1, 2, 99, "u")], "y int, a int, f int, g string")).collect()


def test_null_categories_have_their_own_rate(spark):
    rows = [(None, 1, "train", i % 2) for i in range(30)] + [(1, i % 2, "train", i % 3) for i in range(60)] + [(None, 0, "test", 0), (2, 0, "test", 0)]
    df = spark.createDataFrame(rows, "cat int, y int, split string, fold int")
    out = {r.cat: r.cat_te for r in FE.target_encode(df, ["cat"], "y").filter("split = 'test'").collect()}
    mean = 60 / 90
    assert out[None] > 0.95 and abs(out[2] - mean) < 1e-12
