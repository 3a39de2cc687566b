"""The registered model queries fit the full settings; nothing scales them down."""

import pytest
from pyspark.ml import Estimator

from surveyspark.plans import QUERIES, q_model
from surveyspark.operators import models as M


class Caught(Exception):
    pass


def caught(spark, monkeypatch, query, where, name):
    """The arguments that a query hands to a step, which then stops it."""
    found = {}

    def step(*args, **kw):
        found["args"] = args
        raise Caught

    monkeypatch.setattr(where, name, step)
    with pytest.raises(Caught):
        QUERIES[query](spark, "")
    return found["args"]


def fitted_by(spark, monkeypatch, query) -> Estimator:
    return caught(spark, monkeypatch, query, q_model, "_fit_and_table")[2]


def test_forest_of_300_trees(spark, monkeypatch):
    forest = fitted_by(spark, monkeypatch, "mdl02_random_forest")
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (300, 10)


def test_boosted_trees_of_250_steps(spark, monkeypatch):
    boosted = fitted_by(spark, monkeypatch, "mdl03_boosted_trees")
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (250, 5)


def test_perceptron_of_1000_steps(spark, monkeypatch):
    assert fitted_by(spark, monkeypatch, "mdl04_perceptron").getMaxIter() == 1000


class Frame:
    """Stands for the encoded rows until the models are handed to their fit."""

    def where(self, _):
        return self


@pytest.mark.parametrize("query, step", [("mdl08_compete", "compete"), ("mdl08b_best_model", "fit_all")])
def test_the_six_models_compete_in_full(spark, monkeypatch, query, step):
    monkeypatch.setattr(q_model, "encoded", lambda *_: (Frame(), q_model.FEATURES))
    models = next(a for a in caught(spark, monkeypatch, query, M, step) if isinstance(a, dict))
    assert models["random_forest"].getNumTrees() == 300
    assert [models[m].getMaxIter() for m in ("boosted_a", "boosted_b", "boosted_c", "perceptron")] == [250, 250, 300, 1000]


def test_the_search_draws_from_the_whole_space(spark, monkeypatch):
    assert caught(spark, monkeypatch, "tun01_random_search", q_model, "_searched")[3] == M.BOOSTED_SPACE
