"""Hourly series: lags, rolling statistics, baselines, forecasting models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcube.operators.mining.trees import GROW_ROWS, fit_boosting, fit_forest
from strandcube.session import packed

LAGS = (1, 2, 3, 24, 168)


def supervised(series: DataFrame, ts: str, y: str, exog: Sequence[str] = (), lags: Sequence[int] = LAGS, rolls: Sequence[int] = (3, 24), by: Sequence[str] = ()) -> DataFrame:
    """Lags, rolling means (and the deviation over the longest window) of earlier rows only; rows without full history go.

    Positional: one row is one step, as the series is hourly. Without ``by`` the
    one series is a row per hour of the period and sorts in one task.
    """
    w = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy(ts)
    made = {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
    for k in rolls:
        back = w.rowsBetween(-k, -1)
        full = F.count(y).over(back) >= k
        made[f"roll_mean_{k}"] = F.when(full, F.avg(y).over(back))
    k = max(rolls)
    back = w.rowsBetween(-k, -1)
    made[f"roll_std_{k}"] = F.when(F.count(y).over(back) >= k, F.stddev_samp(y).over(back))
    made |= {f"{c}_lag_1": F.lag(c, 1).over(w) for c in exog}
    out = series.withColumns(made)
    return out.dropna(subset=[y, *made])


def tail_split(df: DataFrame, ts: str, horizon: int) -> DataFrame:
    """Adds ``is_test``: the last ``horizon`` rows."""
    back = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(ts)))
    return df.withColumn("is_test", (back <= horizon).cast("int"))


def fit_models(train: DataFrame, features: Sequence[str], y: str, ridge_alpha: float = 1.0, forest: tuple[int, int] = (250, 16), boosting: tuple[int, int] = (400, 3), seed: int = 42, names: Sequence[str] = ("ridge", "random_forest", "gradient_boosting")) -> dict:
    """Ridge, random forest and gradient boosting (those named) on assembled features ``_x``.

    Trees grow whole in tasks (:mod:`trees`), by MLlib where the rows are more than a task can hold.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(packed(train)).persist()
    row = rows.agg(F.stddev_pop(y).alias("s"), F.count(F.lit(1)).alias("n")).first()
    reg = ridge_alpha * float(row["s"] or 1.0) / max(row["n"], 1)
    local = row["n"] <= GROW_ROWS
    kinds = {
        "ridge": lambda: LinearRegression(featuresCol="_x", labelCol=y, regParam=reg, elasticNetParam=0.0, standardization=False).fit(rows),
        "random_forest": lambda: fit_forest(rows, y, *forest, 3, seed=seed) if local else RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=forest[0], maxDepth=forest[1], minInstancesPerNode=3, featureSubsetStrategy="all", maxMemoryInMB=1024, seed=seed).fit(rows),
        "gradient_boosting": lambda: fit_boosting(rows, y, *boosting, 0.05, seed) if local else GBTRegressor(featuresCol="_x", labelCol=y, maxIter=boosting[0], maxDepth=boosting[1], stepSize=0.05, seed=seed).fit(rows),
    }
    return {n: kinds[n]() for n in names}


def predict(models: dict, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    for name, m in models.items():
        out = m.setPredictionCol(f"pred_{name}").transform(out)
    return out.drop("_x")
