"""Forecast models that grow in tasks against what MLlib's give, and without its job for each tree."""

import numpy as np
import pytest

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from strandcube.operators.mining import series
from strandcube.operators.mining.series import fit_models, predict


def test_forecast_trees_grow_in_tasks_and_agree_with_mllib(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a job for each tree")

    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, (400, 2)).astype(float)
    y = np.sin(x[:, 0]) + 0.1 * x[:, 1]
    df = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(x, y, strict=True)], "a double, b double, y double").coalesce(1)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df)
    theirs = GBTRegressor(featuresCol="_x", labelCol="y", maxIter=6, maxDepth=3, stepSize=0.05, seed=42).fit(rows)
    want = {(r.a, r.b): r.prediction for r in theirs.transform(rows).collect()}
    monkeypatch.setattr(series, "RandomForestRegressor", never)
    monkeypatch.setattr(series, "GBTRegressor", never)
    models = fit_models(df, ["a", "b"], "y", forest=(20, 8), boosting=(6, 3), names=("random_forest", "gradient_boosting"))
    out = predict(models, df, ["a", "b"]).collect()
    assert len(out) == 400 and all(r.pred_gradient_boosting == pytest.approx(want[r.a, r.b]) for r in out)
    assert np.mean([abs(r.pred_random_forest - r.y) for r in out]) < 0.15
