import numpy as np
import pytest

from strandcube.operators.mining import classify
from strandcube.queries import mining


def test_folds_grow_their_forests_in_tasks(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a fold's forest went through MLlib")

    x = np.random.default_rng(8).random((200, 2))
    df = spark.createDataFrame([(*map(float, p), "a", float(p[0] > 0.5), 1.0, i % 5) for i, p in enumerate(x)], "x double, z double, kind string, label double, weight double, fold int")
    monkeypatch.setattr(classify, "RandomForestClassifier", never)
    got = classify.cross_validate(df, ["x", "z"], ["kind"], "label", names=("random_forest",), trees=12)
    assert got[0][0] == "random_forest" and 0.85 < got[0][1] <= 1


def test_folds_and_fits_share_the_split(spark, monkeypatch):
    made = []
    rows = spark.createDataFrame([(0, 1.0)], "is_test int, label double")
    monkeypatch.setattr(mining, "_severity_split", lambda *_: made.append(1) or rows)
    monkeypatch.setattr(mining, "cross_validate", lambda *_, **__: [("m", 1.0, 0.0)])
    monkeypatch.setattr(mining, "fit_classifiers", lambda *_, **__: {"random_forest": None})
    monkeypatch.setattr(mining, "feature_importances", lambda *_: [("f", 1.0)])
    assert mining.severity_cv(spark, "/root/testdata/sf0.01").count() == mining.severity_importances(spark, "/root/testdata/sf0.01").count() == len(made) == 1
