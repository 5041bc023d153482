"""Calibration of predictions: linear models, trees and their accuracy on rows held out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweft.operators.tables import dealt, drop, new_path

BAGGED_ROWS = 200_000  # fixed value: rows of a partition that a forest's training caches, each with a count for every tree


def _rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Vectors and labels; rows with a null among them are left out."""
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=features, outputCol="features").transform(whole)


def least_squares(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """term, coefficient: the exact solution of the normal equations, summed up by the tasks."""
    m = LinearRegression(solver="normal", standardization=False).fit(_rows(df, features, label))
    rows = [("intercept", float(m.intercept)), *zip(features, map(float, m.coefficients))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def generalised(df: DataFrame, features: list[str], label: str, family: str = "binomial", min_rows: int = 51) -> DataFrame:
    """term, coefficient, p_value; no rows when fewer than ``min_rows`` rows are given."""
    spark, rows = df.sparkSession, _rows(df, features, label)
    kind = "term string, coefficient double, p_value double"
    if rows.limit(min_rows).count() < min_rows:
        return spark.createDataFrame([], kind)
    m = GeneralizedLinearRegression(family=family, link="logit" if family == "binomial" else "identity").fit(rows)
    values = [*map(float, m.coefficients), float(m.intercept)]
    return spark.createDataFrame(list(zip([*features, "intercept"], values, map(float, m.summary.pValues))), kind)


def forest(features: list[str], label: str, seed: int = 7):
    """Pipeline of a forest of 50 trees with two features a split."""
    model = RandomForestClassifier(numTrees=50, featureSubsetStrategy="2", featuresCol="features", labelCol=label, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model])


@dataclass(frozen=True)
class Node:
    """A node of a tree: the weights of its rows by class; its feature and bound, left and right (None, -1 in a leaf)."""

    weights: tuple[float, ...]
    feature: str | None = None
    bound: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def risk(self) -> float:
        return sum(self.weights) - max(self.weights)

    @property
    def prediction(self) -> int:
        return self.weights.index(max(self.weights))


Tree = dict[int, Node]


def class_weights(sizes: dict[int, int], prior: tuple[float, float] | None = None, loss: tuple[float, float] = (1.0, 1.0)) -> dict[int, float]:
    """Weight of a row by its class, so that weighted errors are losses under the prior: ``prior`` (null: the classes' shares)
    times ``loss`` (of a row of the class that is judged wrong) over the class's share."""
    n = sum(sizes.values())
    return {c: (prior[c] / (k / n) if prior else 1.0) * loss[c] for c, k in sizes.items() if k}


def grown_tree(df: DataFrame, features: list[str], label: str, prior: tuple[float, float] | None = None, loss: tuple[float, float] = (1.0, 1.0), max_depth: int = 6, seed: int = 7) -> Tree:
    """The whole tree (root 0) of rows without nulls, by Spark ML on weighted rows; labels are 0 and 1. At most
    2^(max_depth + 1) nodes come to the driver. No rows: a single leaf without weight."""
    rows = _rows(df, features, label)
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {0: Node(tuple(float(sizes.get(c, 0)) for c in (0, 1)))}
    w = class_weights(sizes, prior, loss)
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, w[1]).otherwise(w[0]))
    model = DecisionTreeClassifier(maxDepth=max_depth, minInfoGain=0.0, labelCol="label", weightCol="weight", seed=seed).fit(weighted)
    path = new_path(df.sparkSession, "tree")
    model.write().save(path)
    nodes = df.sparkSession.read.parquet(f"{path}/data").collect()
    drop(df.sparkSession, path)
    out = {}
    for r in nodes:
        n = r["nodeData"] if "nodeData" in r.asDict() else r
        inner, split = n["leftChild"] >= 0, n["split"]
        out[n["id"]] = Node(tuple(n["impurityStats"]), features[split["featureIndex"]] if inner else None, float(split["leftCategoriesOrThreshold"][0]) if inner else 0.0, n["leftChild"], n["rightChild"])
    return out


def pruned(tree: Tree, cp: float) -> Tree:
    """The smallest subtree of least risk + alpha * leaves, with alpha = ``cp`` times the root's risk (weakest-link pruning)."""
    alpha = cp * tree[0].risk

    def settle(i: int) -> tuple[float, Tree]:
        node = tree[i]
        alone = node.risk + alpha
        if node.feature is None:
            return alone, {i: node}
        (a, left), (b, right) = settle(node.left), settle(node.right)
        if alone <= a + b + 1e-9 * max(1.0, alone):
            return alone, {i: replace(node, feature=None, left=-1, right=-1)}
        return a + b, {i: node} | left | right

    return settle(0)[1]


def leaves(tree: Tree) -> int:
    return sum(n.feature is None for n in tree.values())


def predicted_by(tree: Tree, i: int = 0) -> Column:
    """The class that the tree predicts, as an expression over its features."""
    node = tree[i]
    if node.feature is None:
        return F.lit(node.prediction)
    return F.when(F.col(node.feature).cast("double") <= node.bound, predicted_by(tree, node.left)).otherwise(predicted_by(tree, node.right))


def _fold(key: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")


def pruned_accuracy(df: DataFrame, key: str, features: list[str], label: str, cps: list[float], prior: tuple[float, float] | None = None, loss: tuple[float, float] = (1.0, 1.0), share: float = 0.2, max_depth: int = 6, seed: int = 7) -> DataFrame:
    """cp, leaves, predicted, rows, correct of the tree pruned by each cp, on the rows held out by a hash of their key."""
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(1000 * share)
    known = df.select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label")).dropna()
    tree = grown_tree(known.where(~test), features, "label", prior, loss, max_depth, seed)
    out = None
    for cp in cps:
        small = pruned(tree, cp)
        said = known.where(test).groupBy(predicted_by(small).alias("predicted")).agg(F.count("*").alias("rows"), F.count_if(predicted_by(small) == F.col("label")).alias("correct"))
        one = said.select(F.lit(cp).alias("cp"), F.lit(leaves(small)).alias("leaves"), "predicted", "rows", "correct")
        out = one if out is None else out.unionByName(one)
    return out


def forest_accuracy(df: DataFrame, key: str, features: list[str], label: str, share: float = 0.2, seed: int = 7) -> DataFrame:
    """predicted, rows, correct of a forest on the rows held out, which are drawn by a hash of their key."""
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(1000 * share)
    known = df.select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label)).dropna()
    train = known.where(~test)
    rows = train.count()
    if rows > BAGGED_ROWS * train.rdd.getNumPartitions():  # only then: the draws of the trees go by partition
        train = dealt(train, key, rows=rows, within=BAGGED_ROWS).sortWithinPartitions(key, *features)
    said = forest(features, label, seed).fit(train).transform(known.where(test))
    return said.groupBy(F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("rows"), F.count_if(F.col("prediction") == F.col(label)).alias("correct"))


def cross_validated(df: DataFrame, key: str, pair: list[str], features: list[str], label: str, grid: list[dict], folds: int = 3, max_depth: int = 6, seed: int = 7) -> DataFrame:
    """setting, fold, leaves, predicted, correct, genes, accuracy of the pruned tree of each setting (cp, and prior and loss if
    wanted) and each fold (T18).

    Folds are drawn by a hash of the key. A fold's tree is grown once for all settings with one prior and loss. ``predicted``
    counts the distinct pairs (gene, function) that a tree accepts, ``accuracy`` is the share of them that are correct, null
    where none is accepted.
    """
    known = df.select(*pair, _fold(key, folds, seed).alias("fold"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label")).dropna()
    out = None
    for k in range(folds):
        grown: dict[tuple, Tree] = {}
        for i, setting in enumerate(grid):
            how = setting.get("prior"), setting.get("loss", (1.0, 1.0))
            if how not in grown:
                grown[how] = grown_tree(known.where(F.col("fold") != k), features, "label", *how, max_depth, seed)
            tree = pruned(grown[how], setting["cp"])
            accepted = known.where((F.col("fold") == k) & (predicted_by(tree) == 1)).groupBy(*pair).agg(F.max("label").alias("c"))
            one = accepted.agg(F.count("*").alias("predicted"), F.coalesce(F.sum("c"), F.lit(0.0)).cast("long").alias("correct"), F.countDistinct(pair[0]).alias("genes"))
            one = one.select(F.lit(i).alias("setting"), F.lit(k).alias("fold"), F.lit(leaves(tree)).alias("leaves"), "predicted", "correct", "genes", (F.col("correct") / F.nullif(F.col("predicted"), F.lit(0))).alias("accuracy"))
            out = one if out is None else out.unionByName(one)
    return out
