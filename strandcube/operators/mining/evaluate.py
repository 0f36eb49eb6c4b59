"""Model evaluation as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.values import ratio


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Per class: ``label, support, precision, recall, f1`` (0 where a denominator is 0)."""
    actual = matrix.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("guesses"))
    rows = actual.join(guessed, "label", "full").fillna(0, ["support", "hits", "guesses"])
    zero = F.lit(0.0)
    rows = rows.withColumns({"precision": F.coalesce(ratio(F.col("hits").cast("double"), F.col("guesses")), zero), "recall": F.coalesce(ratio(F.col("hits").cast("double"), F.col("support")), zero)})
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return rows.select("label", "support", "precision", "recall", f1.alias("f1"))


def summary(matrix: DataFrame) -> DataFrame:
    """One row: ``accuracy, macro_precision, macro_recall, macro_f1``."""
    acc = matrix.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("accuracy"))
    macro = class_report(matrix).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    key = {"_one": F.lit(1)}
    return acc.withColumns(key).join(F.broadcast(macro.withColumns(key)), "_one").drop("_one")  # one row each


def regression_metrics(df: DataFrame, actual: str, predicted: str):
    """Aggregates mae, rmse, mape (percent, zero actuals skipped) and r2."""
    a, p = F.col(actual), F.col(predicted)
    sse, mean_sq = F.sum((a - p) * (a - p)), F.sum(a * a) - F.count(a) * F.avg(a) * F.avg(a)
    return [
        F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        (F.avg(F.abs(a - p) / F.abs(F.nullif(a, F.lit(0.0)))) * 100).alias("mape"), (1 - sse / F.nullif(mean_sq, F.lit(0.0))).alias("r2"),
    ]


def rank_fraction(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank of ties divided by n. Meant for small tables (one row per entity)."""
    w = Window.partitionBy(F.lit(1))
    ties = Window.partitionBy(column)
    rank = F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return df.withColumn(name, rank / F.count(F.lit(1)).over(w))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds n / (k * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return df.join(F.broadcast(counts), label).withColumn(name, F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("_nc"))).drop("_nc")


def stratified_holdout(df: DataFrame, label: str, key: str, fraction: float = 0.25, seed: int = 42, folds: int = 5) -> DataFrame:
    """Adds ``is_test`` (exactly round(fraction * n) rows per class, drawn by hash) and ``fold`` (0..folds-1 for the others).

    Ranks come from cells of the hash: counts of the cells below plus a window
    within one cell, so that no class is sorted in one task.
    """
    rows = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_c", F.pmod(F.shiftright("_h", 24), F.lit(256)))
    cells = rows.groupBy(label, "_c").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    cells = cells.withColumns({"_before": F.sum("_n").over(w.orderBy("_c")) - F.col("_n"), "_all": F.sum("_n").over(w)}).drop("_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_c").orderBy("_h", key))
    out = rows.join(cells, [label, "_c"]).withColumn("_r", rank)
    n_test = F.round(F.col("_all") * fraction)
    out = out.withColumns({"is_test": (F.col("_r") <= n_test).cast("int"), "fold": F.pmod(F.col("_r"), F.lit(folds)).cast("int")})
    return out.drop("_h", "_c", "_before", "_all", "_r")


def mark_best(scores: DataFrame, metric: str, largest: bool = True, among: Column | None = None) -> DataFrame:
    """Adds ``is_best`` (0/1): the model of the greatest (or least) metric among those allowed; ties go to the first name. A row per model."""
    value = F.when(F.lit(True) if among is None else among, F.col(metric))
    order = [F.desc_nulls_last("_v") if largest else F.asc_nulls_last("_v"), F.asc("model")]
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return scores.withColumn("_v", value).withColumn("is_best", ((rank == 1) & F.col("_v").isNotNull()).cast("int")).drop("_v")
