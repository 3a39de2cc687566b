"""What the fits, searches and metrics keep: no second copy of the rows, no row checkpoints of the scores."""

import functools
import glob
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import evaluate as EV
from surveyspark.operators import models as M
from surveyspark.operators.encoder import vector_of
from surveyspark.session import ensure_checkpoint_dir, staging


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 2))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    rows = [(float(a), float(b), float(c), float(i % 4 + 1), i % 3) for i, ((a, b), c) in enumerate(zip(x, y))]
    return M.assemble(spark.createDataFrame(rows, "a double, b double, label double, w double, fold int"), ["a", "b"])


def test_auc_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(EV, "score_ranges", functools.partial(EV.score_ranges, rows_per_range=7))
    rng = np.random.default_rng(1)
    rows = [(int(g), int(y), float(s), float(w)) for g, y, s, w in
            zip(rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 60, 300) / 60, rng.uniform(0.5, 2, 300))]
    rows += [(0, 1, float("inf"), 1.5), (0, 0, float("-inf"), 0.5), (1, 0, float("nan"), 1.0), (1, 1, None, 2.0)]
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = len(glob.glob(f"{folder}/**/rdd-*", recursive=True))
    got = {r["g"]: r["auc"] for r in EV.weighted_auc(spark.createDataFrame(rows, "g int, y int, s double, w double"), "y", "s", "w", ["g"]).collect()}
    assert len(glob.glob(f"{folder}/**/rdd-*", recursive=True)) == before       # nothing is checkpointed row by row

    def place(s):           # nulls first, NaN last
        return (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)

    for g in (0, 1):
        pos = [(place(s), w) for h, y, s, w in rows if h == g and y == 1]
        neg = [(place(s), w) for h, y, s, w in rows if h == g and y == 0]
        num = sum(a * b * (1.0 if p > q else 0.5 if p == q else 0.0) for p, a in pos for q, b in neg)
        assert got[g] == pytest.approx(num / (sum(a for _, a in pos) * sum(b for _, b in neg)), abs=1e-12)


def test_searches_and_kernel_fits_keep_no_copy(frame, monkeypatch):
    def kept(*_):
        raise AssertionError("a copy of the rows is kept")

    monkeypatch.setattr(type(frame), "persist", kept)
    monkeypatch.setattr(type(frame), "cache", kept)
    found, table = M.random_search(M.ridge_logistic(weight="w"), {"C": [0.1, 1.0]}, frame, "fold", n_draws=2, w="w")
    assert table.count() == 2 and found["model"].numFeatures == 2
    svm = M.RbfSvm(C=1.0, gamma=0.3, nFeatures=20, weightCol="w", maxIter=10, foldCol="fold").fit(frame)
    assert M.positive_probability(svm.transform(frame)).where("prob between 0 and 1").count() == 400
    with pytest.raises(ValueError):
        M.random_search(M.ridge_logistic(weight="w"), {"C": [0.1]}, frame.withColumn("fold", F.nullif("fold", F.lit(1))), "fold", n_draws=1)


def test_kernel_features(spark, frame):
    from surveyspark.operators.svm import FourierFeatures
    fmap = FourierFeatures.seeded(2, 8, 0.3, 5, "features")
    rows = fmap.transform(frame).select("features", fmap.getOutputCol()).collect()
    w, b = np.array(fmap.getOrDefault("W")), np.array(fmap.getOrDefault("b"))
    assert np.allclose([r[1].toArray() for r in rows], 0.5 * np.cos(np.array([r[0].toArray() for r in rows]) @ w + b), atol=1e-12)
    assert not fmap.transform(frame.where("a > 1e9")).collect()


def test_vectors_of_numbers(spark):
    df = spark.createDataFrame([(1, 2.5), (None, 0.0)], "a int, b double").withColumn("v", vector_of(["a", "b"]))
    assert sorted(map(str, (r["v"].toArray() for r in df.collect()))) == ["[1.  2.5]", "[nan  0.]"]


def test_settings_of_staging_return_after_the_last_thread(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    first, second = threading.Event(), threading.Event()

    def outer():
        with staging(spark):
            first.set()
            second.wait(20)

    t = threading.Thread(target=outer)
    t.start()
    first.wait(20)
    with staging(spark):
        second.set()
        t.join()
        assert spark.conf.get(key) == "8000"
    assert spark.conf.get(key, None) == before
