"""Trees that grow within a task: splits against brute force, forests and boosting against what they must find."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strandcube.operators.mining import classify, trees
from strandcube.operators.mining.classify import fit_classifiers
from strandcube.queries import mining


class Seen(Exception):
    pass


def _best(codes, sizes, y, m, least, weights):
    def purity(rows):
        w = np.array([(m[rows] * (y[rows] == c)).sum() for c in range(len(weights))]) * weights
        return (w * w).sum() / w.sum()

    every = np.arange(len(y))
    splits = [(f, c, codes[f] <= c) for f in range(len(codes)) for c in range(sizes[f] - 1)]
    return max(((purity(every[lo]) + purity(every[~lo]) - purity(every), f, c) for f, c, lo in splits if min(m[lo].sum(), m[~lo].sum()) >= least), key=lambda x: x[0])


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    sizes, weights = np.array([8, 2, 5]), np.array([1.0, 2.5, 0.7])
    for _ in range(5):
        codes, y, m = np.stack([rng.integers(0, s, 300) for s in sizes]), rng.integers(0, 3, 300), rng.poisson(1.0, 300).astype(float)
        (feature, cut, child, value), gains = trees.grow((codes * 3 + y).astype(np.uint8), sizes, y.astype(float), m, rng, 1, 5, 3, weights)
        gain, f, c = _best(codes, sizes, y, m, 5, weights)
        assert (feature[0], cut[0], len(child)) == (f, c, 3) and gains[f] == pytest.approx(gain) and np.allclose(value.sum(1), 1)


def test_leaves_hold_the_mean_of_their_rows():
    rng = np.random.default_rng(2)
    codes, m = np.stack([rng.integers(0, 32, 500), rng.integers(0, 2, 500)]).astype(np.uint8), np.ones(500)
    y = codes[0] * 1.0 + 10 * codes[1] + rng.normal(0, 0.1, 500)
    tree, _ = trees.grow(codes, np.array([32, 2]), y, m, rng, 4, 3, 2)
    leaf = trees.reached(tree, codes, 4)
    assert len(set(leaf)) == 16 and min(np.bincount(leaf)[np.unique(leaf)]) >= 3
    assert all(tree[3][k, 0] == pytest.approx(y[leaf == k].mean()) for k in set(leaf))


def test_forest_of_the_query_is_grown_in_tasks_over_all_rows(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("the forest of these few rows went through MLlib's passes over all nodes")

    rng = np.random.default_rng(3)
    x, kind = rng.random((600, 2)), rng.choice(["a", "b"], 600)
    label = (x[:, 0] > 0.5).astype(float) + 2 * (kind == "a")
    df = spark.createDataFrame([(*map(float, p), str(k), float(v), 1.0) for p, k, v in zip(x, kind, label, strict=True)], "x double, z double, kind string, label double, weight double")
    monkeypatch.setattr(classify, "classifier", never)
    model = fit_classifiers(df, ["x", "z"], ["kind"], "label", names=("random_forest",), trees=30)["random_forest"]
    out = model.transform(df)
    assert out.count() == 600 and out.where("label = prediction").count() > 570
    names = [n for n, _ in classify.feature_importances(model, df, 4)]
    assert names.index("x") < names.index("z") and sum(model.stages[-1].featureImportances) == pytest.approx(1)


def test_weights_that_differ_within_a_class_go_to_mllib(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (1.0, 1.0)], "label double, weight double")
    assert classify._class_weights(df, "label", "weight") is None
    assert classify._class_weights(df.where("weight = 1"), "label", "weight") == [1.0, 1.0]


def test_cuts_are_the_values_or_equal_shares(spark):
    df = spark.range(6400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    a, b = trees.find_edges(VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df))
    assert a.tolist() == [200.0 * k - 1 for k in range(1, 32)] and b.tolist() == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_importances_fit_the_forest_only(spark, monkeypatch):
    def fit(*_, names=classify.MODELS, trees=300, **__):
        raise Seen(names, trees)

    monkeypatch.setattr(mining, "fit_classifiers", fit)
    with pytest.raises(Seen) as e:
        mining.severity_importances(spark, "/root/testdata/sf0.001")
    assert e.value.args == (("random_forest",), 300)
