"""Estimators and tuning (MDL-1..4, MDL-8, TUN-1, TUN-2) on MLlib; MDL-5 is in ``svm``.

Models train on one checkpointed encoded frame with a ``features`` vector column;
every metric afterwards is a grouped DataFrame pass (``evaluate``).
"""

from __future__ import annotations

import math
import random
from typing import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators import evaluate as EV
from surveyspark.operators import together as TG
from surveyspark.operators.encoder import vector_of
from surveyspark.operators.svm import RbfSvm
from surveyspark.session import staged


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    if cols and all(c in df.columns and isinstance(df.schema[c].dataType, T.NumericType) for c in cols):
        return df.withColumn(out, vector_of(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def sum_of_weights(df: DataFrame, weight: str | None) -> float:
    """The weight of the rows being fitted (their number without a weight)."""
    total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    if not total or total <= 0:
        raise ValueError("no weight to fit on")
    return float(total)


class RidgeLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """MDL-1: L2 logistic regression that minimises C * weighted loss + |coefficients|^2 / 2.

    MLlib averages the loss over the weights, so regParam = 1 / (C * sum of the
    weights of the rows being fitted), computed in ``fit``. No internal standardisation.
    """

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="", C=1.0, maxIter=100):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", C=1.0, maxIter=100)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame):
        weight = self.getWeightCol()
        kw = {"weightCol": weight} if weight else {}
        reg = 1.0 / (self.getOrDefault("C") * sum_of_weights(df, weight or None))
        return LogisticRegression(elasticNetParam=0.0, regParam=reg, standardization=False, maxIter=self.getOrDefault("maxIter"),
                                  labelCol=self.getLabelCol(), featuresCol=self.getFeaturesCol(), **kw).fit(df)


def ridge_logistic(C: float = 1.0, weight: str | None = "w", max_iter: int = 100) -> RidgeLogistic:
    """MDL-1: the estimator; its penalty follows the rows that it is fitted on."""
    return RidgeLogistic(C=C, weightCol=weight or "", maxIter=max_iter)


def random_forest(trees: int = 300, depth: int = 10, min_leaf: int = 1, weight: str | None = "w", seed: int = 2018):
    """MDL-2: weighted random forest."""
    kw = dict(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed,
              labelCol="label", featuresCol="features")
    if weight:
        kw["weightCol"] = weight
    return RandomForestClassifier(**kw)


def boosted_trees(iters: int = 250, depth: int = 4, rate: float = 0.05, min_leaf: int = 1,
                  subsample: float = 1.0, weight: str | None = "w", seed: int = 2018):
    """MDL-3: weighted gradient-boosted trees (one MLlib implementation stands in for three libraries)."""
    kw = dict(maxIter=iters, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf,
              subsamplingRate=subsample, seed=seed, labelCol="label", featuresCol="features")
    if weight:
        kw["weightCol"] = weight
    return GBTClassifier(**kw)


def perceptron(n_in: int, hidden: Sequence[int] = (64, 32), max_iter: int = 200, seed: int = 2018):
    """MDL-4: multilayer perceptron (unweighted, as in the reference)."""
    return MultilayerPerceptronClassifier(layers=[n_in, *hidden, 2], maxIter=max_iter, seed=seed,
                                          labelCol="label", featuresCol="features")


def positive_probability(scored: DataFrame, out: str = "prob") -> DataFrame:
    """JN-3: predictions stay attached to their rows; take P(class 1) from the probability vector."""
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


def six_models(weight: str | None = "w", n_in: int = 39, seed: int = 2018) -> dict:
    """MDL-8: the six competitors with their full settings.

    One MLlib implementation stands in for three boosting libraries. They differ in
    what the libraries differ in by default: steps and the smallest leaf.
    """
    return {"logistic": ridge_logistic(C=1.0, weight=weight, max_iter=100),
            "random_forest": random_forest(trees=300, depth=10, weight=weight, seed=seed),
            "boosted_a": boosted_trees(iters=250, depth=5, rate=0.04, min_leaf=1, weight=weight, seed=seed),
            "boosted_b": boosted_trees(iters=250, depth=5, rate=0.04, min_leaf=20, weight=weight, seed=seed),
            "boosted_c": boosted_trees(iters=300, depth=5, rate=0.04, min_leaf=1, weight=weight, seed=seed),
            "perceptron": perceptron(n_in, (64, 32), max_iter=1000, seed=seed)}


def in_parallel(spark, work, items: Sequence, parallelism: int) -> list:
    """``work`` of every item, ``parallelism`` at a time."""
    from multiprocessing.pool import ThreadPool
    from pyspark import inheritable_thread_target
    pool = ThreadPool(max(1, min(parallelism, len(items))))
    try:
        return pool.map(inheritable_thread_target(spark)(work), list(items), chunksize=1)
    finally:
        pool.close()


def fit_all(train: DataFrame, models: Mapping[str, object], parallelism: int = 2) -> dict:
    """Fit several estimators, ``parallelism`` at a time, on one frame (staged by the caller).

    Each fit keeps blocks of all training rows in memory or on disk, so few run at once.
    """
    return dict(zip(models, in_parallel(train.sparkSession, lambda est: est.fit(train), list(models.values()), parallelism)))


def scored_by_all(fitted: Mapping[str, object], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """model, keep..., prob of every row under every fitted model."""
    out = None
    for name, m in fitted.items():
        s = positive_probability(m.transform(df)).select(F.lit(name).alias("model"), *keep, "prob")
        out = s if out is None else out.unionByName(s)
    return out


def compete(train: DataFrame, evaluate_on: DataFrame, models: Mapping[str, object], y: str = "label",
            w: str | None = "w", split: str = "split") -> tuple[dict, DataFrame]:
    """MDL-8: fit several models on one encoded frame (checkpointed by the caller); score every model on every
    partition and compute AUC / log loss / macro F1 in one grouped pass."""
    fitted = fit_all(train, models)
    scored = scored_by_all(fitted, evaluate_on, list(dict.fromkeys([split, y, *([w] if w else [])])))
    return fitted, EV.metric_table(scored, y, "prob", w, ["model", split])


def sample_params(space: Mapping[str, object], n: int, seed: int) -> list[dict]:
    """TUN-1: seeded random draws; a list draws uniformly, a ('log', lo, hi) tuple log-uniformly."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        d = {}
        for k, v in space.items():
            if isinstance(v, tuple) and v and v[0] == "log":
                d[k] = math.exp(rnd.uniform(math.log(v[1]), math.log(v[2])))
            else:
                d[k] = rnd.choice(list(v))
        out.append(d)
    return out


class WeightedAuc(Evaluator, HasLabelCol, HasWeightCol):
    """Tie-aware weighted ROC AUC of the positive-class probability (``evaluate.weighted_auc``)."""

    @keyword_only
    def __init__(self, *, labelCol="label", weightCol=""):
        super().__init__()
        self._setDefault(labelCol="label", weightCol="")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        found = EV.weighted_auc(positive_probability(dataset), self.getLabelCol(), "prob", self.getWeightCol() or None).first()
        return float("nan") if found is None or found["auc"] is None else float(found["auc"])

    def isLargerBetter(self) -> bool:
        return True


#: TUN-1: the search spaces of the boosted trees and of the kernel classifier (fixed values). MLlib's trees
#: have no L2 leaf penalty, so the smallest leaf takes the place of ``l2_leaf_reg``.
BOOSTED_SPACE = {"maxIter": [80, 100, 120], "maxDepth": [2, 3], "stepSize": [0.01, 0.02, 0.03], "minInstancesPerNode": [150, 180, 220]}
SVM_SPACE = {"C": ("log", 1e-2, 1e2), "gamma": ("log", 1e-3, 1e1)}


def random_search(estimator, space: Mapping[str, object], df: DataFrame, fold: str, n_draws: int = 6, seed: int = 2018,
                  w: str | None = None, parallelism: int = 2) -> tuple[dict, DataFrame]:
    """TUN-1: randomised search with group folds; the draw with the best mean validation AUC is refitted on all rows.

    ``estimator`` is any ``pyspark.ml`` estimator and ``space`` names its params.
    ``fold`` holds whole numbers from 0, one cluster in one fold. ``parallelism`` fits run
    at a time, those of an ``RbfSvm`` all in step; the first of equal draws wins. The folds are read from ``df`` (staged by the
    caller); ``CrossValidator`` would keep a whole copy of every fold.
    """
    draws = sample_params(space, n_draws, seed)
    maps = [{estimator.getParam(k): v for k, v in d.items()} for d in draws]
    least, most, without = df.agg(F.min(fold), F.max(fold), F.count_if(F.col(fold).isNull())).first()
    if least is None or least < 0 or without:
        raise ValueError(f"{fold} must hold whole numbers from 0")
    k = most + 1
    evaluator = WeightedAuc(weightCol=w or "")

    def validated(fold_and_map) -> float:
        f, params = fold_and_map
        model = estimator.fit(df.where(F.col(fold) != f), params)
        return evaluator.evaluate(model.transform(df.where(F.col(fold) == f)))

    found = estimator.validation_aucs(df, fold, k, maps, w) if isinstance(estimator, RbfSvm) else None
    if found is None:
        found = in_parallel(df.sparkSession, validated, [(f, m) for f in range(k) for m in maps], parallelism)
    means = [sum(found[i::len(maps)]) / k for i in range(len(maps))]
    rows = [(i, ", ".join(f"{a}={d[a]}" for a in sorted(d)), float(m)) for i, (d, m) in enumerate(zip(draws, means))]
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    return ({"params": draws[best], "model": estimator.fit(df, maps[best])},
            df.sparkSession.createDataFrame(rows, "draw INT, params STRING, mean_auc DOUBLE"))


def learning_curve(make, df: DataFrame, sizes: Sequence[float], fold: str, seed: int, key: Sequence[str],
                   y: str = "label", w: str | None = None) -> DataFrame:
    """TUN-2: for each training fraction (nested, SPL-6) and fold: train / validation AUC; mean per size.

    The fits of a ``RidgeLogistic`` go in step over one staged copy of the rows (``together``), and one pass scores all
    of them; any other estimator is fitted once for each size and fold.
    """
    from surveyspark.operators.split import unit_hash
    u = unit_hash(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    base = df.withColumn("_u", u)
    folds = sorted(r[0] for r in base.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    tasks = [(s, f) for s in sizes for f in folds]
    made = [make() for _ in tasks]
    if tasks and len(tasks) <= TG.MOST_SUBSETS and all(isinstance(m, RidgeLogistic) and m.getLabelCol() == y for m in made):
        auc = _ridge_aucs(base, made, tasks, folds, fold, w)
        return auc.groupBy("size").pivot("part", ["train", "validation"]).agg(F.avg("auc"))
    parts = []
    for m, (s, f) in zip(made, tasks):
        tr = base.where((F.col(fold) != f) & (F.col("_u") < s))
        m = m.fit(tr)
        for part, d in (("train", tr), ("validation", base.where(F.col(fold) == f))):
            parts.append(positive_probability(m.transform(d)).select(
                F.lit(float(s)).alias("size"), F.lit(f).alias("_fold"), F.lit(part).alias("part"), y,
                *([w] if w else []), "prob"))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    auc = EV.weighted_auc(allp, y, "prob", w, ["size", "_fold", "part"])
    return auc.groupBy("size").pivot("part", ["train", "validation"]).agg(F.avg("auc"))


def _ridge_aucs(base: DataFrame, made: Sequence[RidgeLogistic], tasks: Sequence[tuple], folds: Sequence, fold: str, w: str | None) -> DataFrame:
    """size, _fold, part and the AUC of each fit on the rows that it learns from, and on those in its fold."""
    import numpy as np
    import pyarrow as pa
    est = made[0]
    place = F.lit(None).cast("long")
    for i, f in enumerate(folds):
        place = F.when(F.col(fold) == f, F.lit(i)).otherwise(place)
    rows = TG.stage_rows(base, est.getFeaturesCol(), est.getLabelCol(), est.getWeightCol() or None,
                         [(F.col(fold) != f) & (F.col("_u") < s) for s, f in tasks], place, w)
    found = TG.fit_linear(rows, [TG.Map()], [TG.Fit(i, None, 0, TG.LOGISTIC, m.getOrDefault("C"), m.getOrDefault("maxIter")) for i, m in enumerate(made)])
    beta, intercept = np.array([b for b, _ in found]), np.array([c for _, c in found])
    at = [folds.index(f) for _, f in tasks]

    def scores(pieces):
        for x, y, _, v, s, f in pieces:
            prob = TG.probability(beta @ x + intercept[:, None])
            for i in range(len(at)):
                for held_out, mine in ((False, np.flatnonzero((s >> i) & 1)), (True, np.flatnonzero(f == at[i]))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), i, np.int32)), pa.array(np.full(len(mine), held_out)), pa.array(y[mine]), pa.array(v[mine]),
                         pa.array(prob[i][mine])], names=["task", "held_out", "label", "w", "prob"])

    by = ["task", "held_out"]
    table = rows.passed(scores, "task int, held_out boolean, label double, w double, prob double",
                        lambda scored: staged(EV.score_table(scored, "label", "prob", "w", by), "scores"))
    return EV.auc_of_scores(table, by).select(F.array(*[F.lit(float(s)) for s, _ in tasks])[F.col("task")].alias("size"),
                      F.array(*[F.lit(i) for i in at])[F.col("task")].alias("_fold"),
                      F.when(F.col("held_out"), "validation").otherwise("train").alias("part"), "auc")


def save_if(model, metric: float, threshold: float, path: str, side_tables: Mapping[str, DataFrame] | None = None) -> bool:
    """SNK-4: persist the model and its side tables only when the quality gate passes (rule Q11).

    A model that cannot be written raises; nothing is reported as saved that isn't.
    """
    if metric is None or metric < threshold:
        return False
    if hasattr(model, "write"):
        model.write().overwrite().save(f"{path}/model")
    else:
        raise TypeError(f"{type(model).__name__} cannot be saved")
    for name, t in (side_tables or {}).items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    return True


__all__ = ["assemble", "ridge_logistic", "random_forest", "boosted_trees", "perceptron", "RbfSvm", "six_models", "fit_all", "scored_by_all", "compete",
           "WeightedAuc", "BOOSTED_SPACE", "SVM_SPACE", "random_search", "learning_curve", "save_if", "positive_probability", "Pipeline"]
