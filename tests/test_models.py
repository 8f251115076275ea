"""The search over models against fits one after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.models import training

FEATURES = ["a", "b"]


def _splits(spark, n=240, folds=3):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = float(a + 0.5 * rng.gauss(0, 1) > 0)
        rows += [(s, "test" if i % folds == s else "train", y, a, b) for s in range(folds)]
    return spark.createDataFrame(rows, "split long, role string, y double, a double, b double")


def test_search_equals_serial_fits(spark):
    splits = _splits(spark)
    wanted = training.chosen("logreg,forest", 2)
    got = training.searched(splits, FEATURES, wanted, at_once=3).collect()
    assert {r.model for r in got} == {"logreg", "forest"} and len(got) == 3 * (3 + 4)
    for r in (r for r in got if r.params == '{"regParam": 0.1}'):
        of = splits.where(F.col("split") == r.split)
        estimator = wanted["logreg"]()
        fitted = training.pipeline(FEATURES, estimator.copy({estimator.regParam: 0.1})).fit(of.where("role = 'train'"))
        y, p = np.array([tuple(x) for x in training.score(fitted, of.where("role = 'test'")).select("y", "p").collect()]).T
        assert r.n == len(y) and r.log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), rel=1e-6)


def test_search_finds_the_lowest_mean_loss(spark):
    got = training.searched(_splits(spark), FEATURES, training.chosen("logreg,perceptron", 2)).collect()
    sets = {}
    for r in got:
        sets.setdefault((r.model, r.params), []).append(r)
    means = {k: sum(r.n * r.log_loss for r in v) / sum(r.n for r in v) for k, v in sets.items()}
    for (model, params), rows in sets.items():
        assert all(r.mean_loss == pytest.approx(means[model, params]) for r in rows)
        assert {r.best for r in rows} == {means[model, params] == min(v for (m, _), v in means.items() if m == model)}
    assert means["logreg", '{"regParam": 0.001}'] < 0.5  # the label follows a feature


def test_search_without_two_classes(spark):
    """A split with one class in training scores 0.5, that is a loss of ln 2 whatever the labels."""
    splits = _splits(spark, 30).withColumn("y", F.lit(1.0))
    got = training.searched(splits, FEATURES, training.chosen("logreg", 2)).collect()
    assert len(got) == 9 and all(r.log_loss == pytest.approx(np.log(2)) for r in got)
    assert {r.params for r in got if r.best} == {'{"regParam": 0.001}'}  # of equal ones the first
