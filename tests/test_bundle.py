import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators import encoder as EN
from surveyspark.operators import models as M
from surveyspark.operators import schema_ops as PRJ
from surveyspark.operators import score as SC
from surveyspark.operators.bundle import RATES, Bundle, IncompleteBundle, load_bundle, save_bundle


def blend(g, ym, yv):
    n, m, v = len(g), g.mean(), g.var(ddof=0)
    lam = n * yv / (n * yv + v) if yv > 0 else 1.0
    return lam * m + (1 - lam) * ym


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 400
    cat = rng.integers(0, 5, n).astype(object)
    cat[:30] = None
    y = rng.integers(0, 2, n)
    y[:30] = 1                                          # missing is a category with a rate of its own
    return pd.DataFrame({"id": range(n), "cat": cat, "name": rng.choice(["a", "b", "c"], n), "x": rng.normal(size=n), "y": y,
                         "fold": rng.integers(0, 3, n)})


def frame(spark, pdf):
    data = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(data, "id int, cat int, name string, x double, y int, fold int")


@pytest.mark.parametrize("inline", [64, 0])
def test_encoder_against_pandas(spark, rows, inline, tmp_path):
    """Plain and out-of-fold encodings, by literal maps or by joins, in memory and reloaded, nulls and unseen levels included."""
    df = frame(spark, rows)
    model = EN.fit_encoder(df, ["x"], ["cat", "name"], "y", "fold")
    model.write().overwrite().save(f"file://{tmp_path}/enc")
    back = EN.SurveyEncoderModel.load(f"file://{tmp_path}/enc")
    ym, yv = rows.y.mean(), rows.y.var(ddof=0)
    new = spark.createDataFrame([(1000, 99, "a", 0.0, 0, 0), (1001, None, "zz", 1.0, 0, 0)], "id int, cat int, name string, x double, y int, fold int")
    for m in (model, back):
        m.inline_levels = inline
        plain = m.transform(df.unionByName(new)).select("id", "cat_te", "name_te", "x_std", "features").toPandas().set_index("id")
        held = m.transform_training(df).toPandas().set_index("id")
        for c in ("cat", "name"):
            key = rows[c].astype(object).where(rows[c].notna(), None)
            for _, r in rows.iterrows():
                same = key.isna() if key[r["id"]] is None else key == key[r["id"]]
                assert plain.loc[r["id"], f"{c}_te"] == pytest.approx(blend(rows.y[same], ym, yv))
                other = rows[rows.fold != r["fold"]]
                assert held.loc[r["id"], f"{c}_te"] == pytest.approx(blend(other.y[same[other.index]], other.y.mean(), other.y.var(ddof=0)))
        assert plain.loc[1000, "cat_te"] == pytest.approx(ym) and plain.loc[1001, "name_te"] == pytest.approx(ym)
        assert plain.loc[1001, "cat_te"] == plain.loc[0, "cat_te"] != pytest.approx(ym)
        assert plain.loc[5, "x_std"] == pytest.approx((rows.x[5] - rows.x.mean()) / rows.x.std(ddof=0))
        assert list(plain.loc[5, "features"]) == pytest.approx([plain.loc[5, c] for c in ("x_std", "cat_te", "name_te")])


def test_categories_keep_their_type_and_empty_training_raises(spark, rows):
    df = frame(spark, rows)
    model = EN.fit_encoder(df, [], ["cat"], "y")
    as_double = model.transform(df.withColumn("cat", F.col("cat").cast("double")))
    assert {r.id: r.cat_te for r in as_double.collect()} == {r.id: r.cat_te for r in model.transform(df).collect()}
    with pytest.raises(ValueError):
        EN.fit_encoder(df.limit(0), [], ["cat"], "y")


SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("cat", T.IntegerType(), True),
                       T.StructField("name", T.IntegerType(), False), T.StructField("x", T.DoubleType(), False)])


def test_checked_records(spark):
    raw = spark.createDataFrame([("1", "4", "a", "0.5"), ("x", None, "b", "1"), ("3", "7", "?", None), ("4", "z", "2", "1e3")],
                                "id string, cat string, name string, x string")
    got = PRJ.checked_records(raw, SCHEMA, {"name": {"a": 1, "b": 2}}).collect()
    assert [r.reject_reason for r in got] == ["", "id", "name:?,x", ""]
    assert (got[0].name, got[0].x, got[0].record) == (1, 0.5, None)
    assert (got[3].name, got[3].cat, got[3].x) == (2, None, 1000.0)
    assert json.loads(got[2].record)["name"] == "?" and json.loads(got[1].record)["id"] == "x"


def test_rejected_labels_are_kept(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,)], "flag string")
    valid, rejected = PRJ.encode_labels(df, {"flag": {"A": 1}})
    assert [r.flag for r in valid.collect()] == [1]
    assert sorted(str(r.flag) for r in rejected.collect()) == ["None", "Z"]


def trained(spark, rows, learner):
    df = frame(spark, rows).withColumn("label", F.col("y").cast("double"))
    encoder = EN.fit_encoder(df, ["x"], ["cat", "name"], "label", "fold")
    model = learner.fit(encoder.transform_training(df))
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    return df, PipelineModel([encoder, *stages])


@pytest.mark.parametrize("learner", [lambda: M.ridge_logistic(weight=None), lambda: M.RbfSvm(nFeatures=20, maxIter=5, folds=2),
                                     lambda: M.random_forest(5, 3, weight=None)], ids=["logistic", "svm", "forest"])
def test_a_reloaded_bundle_scores_alike(spark, rows, learner, tmp_path):
    df, pipeline = trained(spark, rows, learner())
    bundle = Bundle(pipeline, ["x", "cat", "name"], dict(zip(RATES, (0.5, 0.3, 0.2))), SCHEMA, {"name": {"a": 1}}, 0.8, 0.7)
    path = f"file://{tmp_path}/bundle"
    assert save_bundle(spark, bundle, path)
    back = load_bundle(spark, path)
    probs = [{r.id: r.prob for r in M.positive_probability(m.transform(df)).collect()} for m in (pipeline, back.model)]
    assert probs[0] == probs[1] and len(probs[0]) == len(rows)
    assert (back.features, back.rates, back.schema, back.label_maps) == (bundle.features, bundle.rates, SCHEMA, {"name": {"a": 1}})


def test_a_bundle_without_its_manifest_is_refused(spark, rows, tmp_path):
    _, pipeline = trained(spark, rows, M.ridge_logistic(weight=None))
    bundle = Bundle(pipeline, ["x"], dict.fromkeys(RATES, 0.1), SCHEMA, {}, 0.6, 0.7)
    path = tmp_path / "bundle"
    assert not save_bundle(spark, bundle, f"file://{path}") and not path.exists()
    with pytest.raises(IncompleteBundle):
        load_bundle(spark, f"file://{path}")
    pipeline.write().save(f"file://{path}/half")          # the model is there, the manifest isn't
    with pytest.raises(IncompleteBundle):
        load_bundle(spark, f"file://{path}")
    (path / "manifest").mkdir()
    (path / "manifest" / "part-0.txt").write_text('{"version": "ha')
    with pytest.raises(IncompleteBundle):
        load_bundle(spark, f"file://{path}")


def test_calibration_uses_held_out_margins(spark):
    """A kernel that can learn its rows by heart: with held-out margins the probabilities stay near the true rate."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (rng.uniform(size=300) < 0.5).astype(float)              # nothing to learn
    df = M.assemble(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, label double"), list("abcd"))
    test = rng.normal(size=(200, 4))
    new = M.assemble(spark.createDataFrame([tuple(map(float, r)) for r in test], "a double, b double, c double, d double"), list("abcd"))
    model = M.RbfSvm(C=100.0, gamma=2.0, nFeatures=200, maxIter=30, folds=4).fit(df)
    p = np.array([r.prob for r in M.positive_probability(model.transform(new)).collect()])
    assert np.abs(p - 0.5).mean() < 0.15


def test_svm_folds_and_unweighted_or_one_class_folds(spark):
    df = M.assemble(spark.createDataFrame([(float(i), float(i % 2), i % 2) for i in range(20)], "a double, label double, f int"), ["a"])
    model = M.RbfSvm(nFeatures=8, maxIter=3, foldCol="f").fit(df)      # without either fold one class is left
    assert model.transform(df).filter("probability is null").count() == 0 and "svm_raw" not in model.transform(df).columns


def test_search_runs_on_group_folds_and_keeps_the_first_of_equals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=240)
    rows = [(float(v), float(v + rng.normal() > 0), int(i % 3), float(rng.uniform(1, 2))) for i, v in enumerate(x)]
    df = M.assemble(spark.createDataFrame(rows, "a double, label double, fold int, w double"), ["a"])
    found, table = M.random_search(M.ridge_logistic(weight="w"), {"C": ("log", 0.01, 10.0), "maxIter": [20]}, df, "fold", n_draws=3, w="w")
    res = table.collect()
    assert len(res) == 3 and all(0.6 < r.mean_auc <= 1 for r in res)
    best = max(res, key=lambda r: (r.mean_auc, -r.draw))
    assert f"C={found['params']['C']}" in best.params and found["model"].transform(df).count() == 240


def test_score_records_splits_and_scores(spark, rows):
    from surveyspark.plans.tables import SURVEY_FIELDS
    from surveyspark.plans.q_bundle import LABELS, SCHEMA as RECORD

    class Constant:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector
            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))

    good = {c: "1" for c in SURVEY_FIELDS} | {"milieuderesidence": "Rural"}
    bad = good | {"region": None, "milieuderesidence": "?"}
    df = spark.createDataFrame([tuple([i, *r.values()]) for i, r in enumerate((good, bad))], "key int, " + ", ".join(f"{c} string" for c in good))
    bundle = Bundle(Constant(), ["ageenfant", "eau_amelioree"], dict(zip(RATES, (0.5, 0.4, 0.2))), RECORD, LABELS)
    scored, rejected = SC.score_records(df, bundle, ["key"])
    s, r = scored.collect(), rejected.collect()
    assert len(s) == len(r) == 1 and s[0].key == 0 and r[0].key == 1
    assert (s[0][SC.PROB], s[0][SC.CLASS], s[0].prob_amaigrissement_wasting) == (0.75, 1, 0.3)
    assert r[0].reject_reason == "milieuderesidence:?,region" and json.loads(r[0].record)["milieuderesidence"] == "?"
