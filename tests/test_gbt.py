"""Trees over blocks are those of Spark's own trainer."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from dockflow.operators import gbt


def rows_of(spark, n=600):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(n, 3)), 2)
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=n) > 0).astype(float)
    flow = np.round(3 * x[:, 0] + x[:, 1] ** 2, 1)
    data = [tuple(map(float, (*r, f, c, 1 + 2 * c))) for r, f, c in zip(x, flow, label)]
    df = spark.createDataFrame(data, "a double, b double, c double, flow double, label double, weight double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).repartition(3).cache()


def nodes(model):
    """Every node of the ensemble as Spark saves it, impurities and counts included."""
    out = []
    for tree in model.trees:
        stack = [tree._call_java("rootNode")]
        while stack:
            node = stack.pop()
            leaf = node.getClass().getSimpleName() == "LeafNode"
            split = (-1, 0.0) if leaf else (node.split().featureIndex(), node.split().threshold())
            stats = node.impurityStats()
            out.append((*split, node.prediction(), node.impurity(), stats.rawCount(), *stats.stats()))
            stack += [] if leaf else [node.leftChild(), node.rightChild()]
    return np.array(out)


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_trees_equal_those_of_spark(spark, monkeypatch, loss):
    monkeypatch.setattr(gbt.boosting, "WRITE_EVERY", 2)
    monkeypatch.setattr(gbt, "FEW_CELLS", 0)
    df = rows_of(spark)
    more = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 5, "seed": 0}
    if loss == "logistic":
        own, spark_ = (k(labelCol="label", weightCol="weight", **more) for k in (gbt.BlockClassifier, GBTClassifier))
    else:
        own, spark_ = (k(labelCol="flow", lossType=loss, **more) for k in (gbt.BlockRegressor, GBTRegressor))
    found, want = own.fit(df), spark_.fit(df)
    a, b = nodes(found), nodes(want)
    a[b[:, 3] == -1, 3] = -1  # what Spark writes for a leaf without a valid split
    assert np.allclose(a, b, atol=1e-9)
    assert found.treeWeights == want.treeWeights and found.getLabelCol() == want.getLabelCol()
    assert np.allclose(found.featureImportances.toArray(), want.featureImportances.toArray())


def test_a_fit_keeps_no_rows_in_memory(spark, monkeypatch):
    """Spark's own trainer persists every row as an object; here no RDD is kept, and its `fit` of Java is not called."""
    monkeypatch.setattr(GBTRegressor, "_fit_java", lambda *a: pytest.fail("rows as objects"))
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    df = rows_of(spark, 60)
    model = gbt.BlockRegressor(labelCol="flow", maxIter=2, maxDepth=2, seed=0).fit(df)
    df.unpersist()
    assert model.getNumTrees == 2 and set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= before


def test_rows_that_cannot_be_split(spark):
    df = rows_of(spark, 40).withColumn("flow", F.lit(2.5))
    model = gbt.BlockRegressor(labelCol="flow", maxIter=2, maxDepth=3, seed=0).fit(df)
    assert model.totalNumNodes == 2 and {r[0] for r in model.transform(df).select("prediction").collect()} == {2.5}
