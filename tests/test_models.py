import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import models as M


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 2))
    w = rng.uniform(0.5, 3.0, 600)
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-2 * x[:, 0] + 0.5))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(b), float(c)) for r, b, c in zip(x, y, w)], "a double, b double, label double, w double")
    return x, y, w, M.assemble(df, ["a", "b"])


@pytest.mark.parametrize("C", [0.01, 1.0])
def test_penalty_follows_the_weights(frame, C):
    """Coefficients equal a Newton fit of C * weighted loss + |beta|^2 / 2."""
    x, y, w, df = frame
    z, beta = np.c_[np.ones(len(x)), x], np.zeros(3)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(C * (z * (w * p * (1 - p))[:, None]).T @ z + ridge, C * z.T @ (w * (p - y)) + ridge @ beta)
    m = M.ridge_logistic(C=C, weight="w", max_iter=200).fit(df)
    assert np.allclose([m.intercept, *m.coefficients], beta, atol=2e-3)


def test_svm_is_saved_and_loaded(spark, frame, tmp_path):
    from pyspark.ml import PipelineModel
    *_, df = frame
    svm = M.RbfSvm(C=1.0, gamma=0.3, nFeatures=40, weightCol="w", maxIter=30, folds=3).fit(df)
    path = f"file://{tmp_path}/svm"
    assert not M.save_if(svm, 0.4, 0.5, path) and M.save_if(svm, 0.9, 0.5, path)
    back = PipelineModel.load(f"{path}/model")
    prob = lambda m: [r[0] for r in M.positive_probability(m.transform(df)).orderBy("a").select("prob").collect()]
    assert prob(svm) == prob(back)
    with pytest.raises(TypeError):
        M.save_if(object(), 0.9, 0.5, path)


def test_csv_tables_bind_by_name(spark, tmp_path):
    from surveyspark.sources.readers import load_table
    (tmp_path / "x.csv").write_text("b,a\n20,1\n")
    assert [(r.a, r.b) for r in load_table(spark, f"file://{tmp_path}/x.csv", "a int, b int", fmt="csv").collect()] == [(1, 20)]


def test_rows_without_a_cluster_keep_their_split(spark):
    from surveyspark.operators import joins as J
    from surveyspark.operators import split as SP
    df = spark.createDataFrame([(i % 5 or None, i) for i in range(50)], "c int, i int")
    st = SP.group_split(df, "c", 0.4, 7)
    out = J.attach_split(df, st, "c")
    assert out.count() == 50 and out.filter("split is null").count() == 0
    kept = J.keep_split(df, st, "c", "test").count()
    assert kept + J.drop_split(df, st, "c", "test").count() == 50


def test_csv_batches_bind_by_name(spark, tmp_path):
    from surveyspark.sources.readers import read_batch
    (tmp_path / "x.csv").write_text("b,extra,a\n20,z,1\nbad,z,2\n")
    rows = {r.a: r for r in read_batch(spark, f"file://{tmp_path}/x.csv", "a int, b int, c string").collect()}
    assert rows[1].b == 20 and rows[1].c is None and rows[1]._corrupt_record is None
    assert any(r._corrupt_record for r in rows.values())
