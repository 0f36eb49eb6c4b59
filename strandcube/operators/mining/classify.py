"""Classifiers of an ordinal label over numeric and categorical features."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.operators.mining.trees import GROW_ROWS, fit_forest
from strandcube.session import packed

MODELS = ("decision_tree", "random_forest", "naive_bayes", "logistic")


def prepare(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages: median-filled standardised numbers and one-hot categories (unknown ones are all zero)."""
    return [
        Imputer(inputCols=list(numeric), outputCols=[f"_n_{c}" for c in numeric], strategy="median"),
        VectorAssembler(inputCols=[f"_n_{c}" for c in numeric], outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_std", withMean=True),
        StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True),
        VectorAssembler(inputCols=["_std", *[f"_o_{c}" for c in categorical]], outputCol="_x"),
    ]


def classifier(name: str, label: str, weight: str | None, n_rows: int, trees: int = 300):
    common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "prediction"}
    w = {"weightCol": weight} if weight else {}
    if name == "decision_tree":
        return DecisionTreeClassifier(**common, **w, maxDepth=8, minInstancesPerNode=25)
    if name == "random_forest":
        return RandomForestClassifier(**common, **w, numTrees=trees, maxDepth=14, minInstancesPerNode=5, maxMemoryInMB=1024, seed=42)
    if name == "naive_bayes":
        return NaiveBayes(**common, modelType="gaussian")
    if name == "logistic":
        return LogisticRegression(**common, **w, family="multinomial", maxIter=200, regParam=1.0 / max(n_rows, 1), standardization=False)
    raise ValueError(f"unknown classifier {name}; known are {', '.join(MODELS)}")


def fit_classifiers(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: str = "weight", names: Sequence[str] = MODELS, trees: int = 300) -> dict[str, PipelineModel]:
    """One fitted pipeline per name; the preparation is fitted once and the models side by side.

    A forest is grown by :func:`trees.fit_forest`, by MLlib where the rows are more
    than a task can hold or the weights differ within a class.
    """
    train = packed(train)
    prep = Pipeline(stages=prepare(numeric, categorical)).fit(train)
    rows = prep.transform(train).persist()
    n = rows.count()

    def fit(name: str):
        by_class = _class_weights(rows, label, weight) if name == "random_forest" and n <= GROW_ROWS else None
        return fit_forest(rows, label, trees, 14, 5, weights=by_class) if by_class else classifier(name, label, weight, n, trees).fit(rows)

    with ThreadPoolExecutor(len(names)) as pool:
        out = {m: PipelineModel(stages=[prep, found]) for m, found in zip(names, pool.map(fit, names), strict=True)}
    rows.unpersist()
    return out


def _class_weights(rows: DataFrame, label: str, weight: str) -> list[float] | None:
    """The weight of each of the classes 0, 1, ...; None if there is no one weight per class."""
    got = rows.groupBy(label).agg(F.min(weight).alias("lo"), F.max(weight).alias("hi")).collect()
    if not got or any(r[label] is None or r[label] < 0 or r[label] % 1 or r.lo != r.hi for r in got):
        return None
    by_class = {int(r[label]): float(r.lo) for r in got}
    return [by_class.get(k, 1.0) for k in range(max(by_class) + 1)] if max(by_class) < 64 else None


def feature_names(model: PipelineModel, rows: DataFrame) -> dict[int, str]:
    """Names of the places of the feature vector, as ``column`` or ``column=value``."""
    attrs = model.stages[0].transform(rows.limit(1)).schema["_x"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    stages = {type(x).__name__: x for x in model.stages[0].stages}  # those of the preparation
    numeric = [c.removeprefix("_n_") for c in stages["ImputerModel"].getOutputCols()]
    out = {}
    for i, n in names.items():
        if n.startswith("_std_"):
            out[i] = numeric[int(n.removeprefix("_std_"))]
        else:  # _o_<column>_<value>
            column = next(c for c in sorted(stages["OneHotEncoderModel"].getOutputCols(), key=len, reverse=True) if n.startswith(f"{c}_"))
            out[i] = f"{column.removeprefix('_o_')}={n.removeprefix(f'{column}_')}"
    return out


def feature_importances(model: PipelineModel, rows: DataFrame, top: int = 15) -> list[tuple[str, float]]:
    """The strongest features of a tree model with their names."""
    names, values = feature_names(model, rows), model.stages[-1].featureImportances.toArray()
    ranked = sorted(((names.get(i, str(i)), float(v)) for i, v in enumerate(values)), key=lambda x: (-x[1], x[0]))
    return ranked[:top]


def tree_rules(model: PipelineModel, rows: DataFrame, labels: Sequence[str], max_depth: int = 4) -> list[str]:
    """A decision tree as indented text down to ``max_depth`` splits, with the names of features and classes."""
    names = feature_names(model, rows)
    out: list[str] = []

    def walk(node, depth: int) -> None:
        pad = "|   " * depth + "|--- "
        if node.numDescendants() == 0 or depth >= max_depth:
            out.append(f"{pad}class: {labels[int(node.prediction())]}" + ("" if node.numDescendants() == 0 else " (cut off)"))
            return
        split = node.split()
        name = names.get(split.featureIndex(), str(split.featureIndex()))
        if split.getClass().getSimpleName() == "ContinuousSplit":
            tests = (f"{name} <= {split.threshold():.4f}", f"{name} > {split.threshold():.4f}")
        else:
            left = ", ".join(f"{x:g}" for x in split.leftCategories())
            tests = (f"{name} in {{{left}}}", f"{name} not in {{{left}}}")
        for test, child in zip(tests, (node.leftChild(), node.rightChild()), strict=True):
            out.append(pad + test)
            walk(child, depth + 1)

    walk(model.stages[-1]._java_obj.rootNode(), 0)
    return out


def cross_validate(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, fold: str = "fold", folds: int = 5, names: Sequence[str] = MODELS, trees: int = 300) -> list[tuple[str, float, float]]:
    """Model, mean and population deviation of the accuracy over the folds, each left out once."""

    def leave_out(k: int) -> dict[str, float | None]:
        models = fit_classifiers(rows.where(F.col(fold) != k), numeric, categorical, label, names=names, trees=trees)
        held = rows.where(F.col(fold) == k)
        return {n: m.transform(held).agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0] for n, m in models.items()}

    with ThreadPoolExecutor(folds) as pool:  # a fold's jobs are small, so the folds run side by side
        by_fold = list(pool.map(leave_out, range(folds)))
    scores = {n: [float(x[n]) for x in by_fold if x[n] is not None] for n in names}
    mean = {n: sum(x) / len(x) for n, x in scores.items() if x}
    return [(n, mean[n], (sum((v - mean[n]) ** 2 for v in scores[n]) / len(scores[n])) ** 0.5) for n in names if n in mean]


def to_label(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    return df.withColumn(name, F.col(column).cast("double") - 1)
