"""Calibration models on small cases with known answers."""

from __future__ import annotations

import numpy as np
import pytest

from netweft.operators import models
from netweft.operators.models import Node
from netweft.plans import catalogue


def subtrees(tree, i=0):
    """All prunings of the tree below a node."""
    node = tree[i]
    out = [{i: Node(node.weights)}]
    if node.feature is not None:
        out += [{i: node} | a | b for a in subtrees(tree, node.left) for b in subtrees(tree, node.right)]
    return out


def cost(tree, alpha):
    return sum(n.risk + alpha for n in tree.values() if n.feature is None)


def random_tree(rng, depth):
    tree, free = {}, [0]

    def make(weights, depth):
        i = free[0]
        free[0] += 1
        if depth == 0 or rng.random() < 0.15 or min(weights) < 2:
            tree[i] = Node(weights)
        else:
            left = tuple(float(rng.integers(0, int(w) + 1)) for w in weights)
            tree[i] = None
            a = make(left, depth - 1)
            b = make(tuple(w - x for w, x in zip(weights, left)), depth - 1)
            tree[i] = Node(weights, "x", 0.0, a, b)
        return i

    make((40.0, 60.0), depth)
    return tree


@pytest.mark.parametrize("seed", range(8))
def test_pruned_tree_is_the_best_of_all_subtrees(seed):
    tree = random_tree(np.random.default_rng(seed), 4)
    every = subtrees(tree)
    for cp in (0.0, 0.01, 0.03, 0.08, 0.2, 1.0):
        alpha = cp * tree[0].risk
        got = models.pruned(tree, cp)
        least = min(cost(t, alpha) for t in every)
        assert cost(got, alpha) == pytest.approx(least)
        assert models.leaves(got) == min(models.leaves(t) for t in every if cost(t, alpha) <= least + 1e-7)


def data(spark, n=2_000):
    """x decides by a step at 0, noise in a tenth of the rows; z is noise."""
    rng = np.random.default_rng(3)
    x, z, wrong = rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.1
    return spark.createDataFrame([(i, i % 40, i % 7, float(a), float(b), int((a > 0) != w)) for i, (a, b, w) in enumerate(zip(x, z, wrong))] + [(n, 1, 1, None, 0.0, 1)], "id long, gene int, go int, x double, z double, y int")


def test_tree_finds_the_step(spark):
    df = data(spark)
    tree = models.grown_tree(df, ["x", "z"], "y")
    assert models.leaves(tree) > 2 and sum(tree[0].weights) == 2_000
    small = models.pruned(tree, 0.05)
    assert models.leaves(small) == 2 and small[0].feature == "x" and abs(small[0].bound) < 0.1
    said = df.dropna().select("y", models.predicted_by(small).alias("p"), "x").collect()
    assert all(r["p"] == int(r["x"] > small[0].bound) for r in said)
    assert models.leaves(models.pruned(tree, 1.0)) == 1
    for i, n in tree.items():
        if n.feature:
            assert np.allclose(np.add(tree[n.left].weights, tree[n.right].weights), n.weights)


def test_prior_and_loss_change_the_decision(spark):
    """One group with 30 percent of class 1: a loss or a prior turns its majority."""
    df = spark.createDataFrame([(i, 1.0, int(i % 10 < 3)) for i in range(100)], "id long, x double, y int")
    says = lambda **how: models.grown_tree(df, ["x"], "y", **how)[0].prediction
    assert says() == 0 and says(loss=(1.0, 2.0)) == 0 and says(loss=(1.0, 3.0)) == 1
    assert says(prior=(0.4, 0.6)) == 1 and says(prior=(0.4, 0.6), loss=(2.0, 1.0)) == 0
    assert models.class_weights({0: 70, 1: 30}, (0.4, 0.6), (1.0, 2.0)) == pytest.approx({0: 0.4 / 0.7, 1: 4.0})
    assert models.grown_tree(df.where("y = 1"), ["x"], "y") == {0: Node((0.0, 30.0))}
    assert models.grown_tree(df.limit(0), ["x"], "y") == {0: Node((0.0, 0.0))}


def test_accuracy_of_pruned_trees(spark):
    rows = models.pruned_accuracy(data(spark), "id", ["x", "z"], "y", [0.0, 0.05, 1.0]).collect()
    by = {cp: [r for r in rows if r["cp"] == cp] for cp in (0.0, 0.05, 1.0)}
    assert len({sum(r["rows"] for r in v) for v in by.values()}) == 1
    assert len(by[1.0]) == 1 and sum(r["correct"] for r in by[0.05]) > 0.85 * sum(r["rows"] for r in by[0.05])


def test_forest_accuracy(spark):
    rows = models.forest_accuracy(data(spark), "id", ["x", "z"], "y").collect()
    assert sum(r["correct"] for r in rows) > 0.8 * sum(r["rows"] for r in rows) > 200


def test_cross_validation_counts_pairs(spark):
    df = data(spark)
    rows = models.cross_validated(df, "id", ["gene", "go"], ["x", "z"], "y", [{"cp": 0.05}, {"cp": 1.0}, {"cp": 0.05, "loss": (50.0, 1.0)}], folds=3).collect()
    assert len(rows) == 9
    by = {s: [r for r in rows if r["setting"] == s] for s in range(3)}
    assert all(r["leaves"] == 2 and 0.85 < r["accuracy"] <= 1 and r["genes"] <= 40 and r["correct"] <= r["predicted"] for r in by[0])
    assert all(r["predicted"] == 0 and r["accuracy"] is None for r in by[2])
    assert all(r["leaves"] == 1 for r in by[1])


def test_logistic_model_recovers_its_coefficients(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    got = {r["term"]: r for r in models.generalised(df, ["a", "b"], "y").collect()}
    for term, want in (("intercept", 0.5), ("a", 1.5), ("b", -1.0)):
        assert abs(got[term]["coefficient"] - want) < 0.1 and got[term]["p_value"] < 1e-6


@pytest.mark.parametrize("name", ["t16_decision_tree", "t18_cross_validation"])
def test_model_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
