"""Verdicts on rules, and the models on planted panels."""

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import models, rules

def only(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_verdicts_and_neighbours(spark):
    rows = [("a", "D1", 50, 0.02), ("a", "D2", 50, 0.01), ("a", "D3", 50, 0.03), ("b", "D1", 50, 0.02), ("b", "D2", 5, 0.02), ("b", "D3", 50, 0.02), ("c", "D1", 50, 0.02), ("c", "D2", 50, 0.02), ("c", "D3", 50, -0.02)]
    stats = spark.createDataFrame(rows, "job string, split string, n long, mean double")
    assert sorted(only(rules.split_verdict(stats, ["job"], F.lit(0.005), 10), "job", "verdict")) == [("a", "HELD"), ("b", "D2_FAILED"), ("c", "D3_FAILED")]
    cuts = spark.createDataFrame([("f", 1.0, 0.1), ("f", 2.0, 0.12), ("f", 3.0, 0.02), ("g", 1.0, 0.5)], "feature string, cut double, right_mean double")
    assert sorted(only(rules.neighbour_cuts(cuts), "feature", "cut", "robust")) == [("f", 1.0, True), ("f", 2.0, False), ("f", 3.0, True), ("g", 1.0, True)]


def test_models_learn_a_planted_panel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = 2 * (x[:, 0] > 0.3) + 0.1 * rng.normal(size=600)
    rows = [(i, float(a), float(b), float(v) if i % 50 else None) for i, ((a, b), v) in enumerate(zip(x, y))]
    panel = spark.createDataFrame(rows, "id long, a double, b double, y double")
    train, test = panel.filter("id < 400"), panel.filter("id >= 400")
    p = np.array(only(models.logistic(train, test, ["a", "b"], F.col("y") > 1), "id", "score"))
    assert len(p) == 200 and np.mean((p[:, 1] > 0.5) == (x[p[:, 0].astype(int), 0] > 0.3)) > 0.95
    s = np.array(only(models.stumps(train, test, ["a", "b"], "y", rounds=10), "id", "score"))
    assert len(s) == 200 and np.corrcoef(s[:, 1], y[s[:, 0].astype(int)])[0, 1] > 0.95
    path = {r.penalty: r for r in models.ridge_path(train, test, ["a", "b"], "y", (0.1, 1e6), ["id"]).collect()}
    assert path[0.1].error < path[1e6].error and path[0.1].spread > 0.5 and path[0.1].n == 196
