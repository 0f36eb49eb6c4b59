"""Cleaning of operational feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.labels import fold_column
from strandcube.functions.values import present
from strandcube.session import cut


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order`` (which should be total). Rows with a NULL in their key are no repeats of each other and all stay."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(known).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").unionByName(df.where(~known))


def void_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside their inclusive range, and not-a-number, become NULL; absent columns are skipped."""
    here = {c: r for c, r in ranges.items() if c in df.columns}
    return df.withColumns({c: F.when(present(F.col(c)).between(lo, hi), F.col(c)) for c, (lo, hi) in here.items()})


def count_void(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> list[Column]:
    """Aggregates n_void_<column>: non-null values outside the range."""
    return [F.sum((~present(F.col(c)).between(lo, hi)).cast("bigint")).alias(f"n_void_{c}") for c, (lo, hi) in ranges.items()]


def fill_group_mode(df: DataFrame, column: str, by: str, default: str) -> DataFrame:
    """NULLs become the most frequent value of their group (ties: the smallest), else ``default``.

    The mode is one small row per group and value, joined back; no group is
    collected.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(F.col(by).alias("_by"), F.col("_m.v").alias("_mode"))
    return df.join(best, df[by].eqNullSafe(best["_by"]), "left").withColumn(column, F.coalesce(column, "_mode", F.lit(default))).drop("_by", "_mode")


def fill_group_median(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """NULLs become the median of their group, then the median of the column after that fill.

    Medians are exact; Spark keeps one counter per distinct value of a group.
    """
    med = df.groupBy(*by).agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    med = med.select(*[F.col(b).alias(f"_b_{b}") for b in by], *[f"_m_{c}" for c in columns])
    same = None
    for b in by:
        one = df[b].eqNullSafe(med[f"_b_{b}"])
        same = one if same is None else same & one
    out = df.join(med, same, "left")
    out = out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_b_{b}" for b in by], *[f"_m_{c}" for c in columns])
    overall = out.agg(*[F.median(c).alias(f"_o_{c}") for c in columns]).first()
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(overall[f"_o_{c}"])) for c in columns})


def group_z(df: DataFrame, column: str, by: Sequence[str], ddof: int = 0) -> DataFrame:
    """Adds ``_mean``, ``_sd`` of the group by a join of its aggregates, so that a hot group is never sorted or collected."""
    sd = F.stddev_pop(column) if ddof == 0 else F.stddev_samp(column)
    stats = df.groupBy(*by).agg(F.avg(column).alias("_mean"), sd.alias("_sd"))
    return df.join(stats, list(by), "left")


def flag_outliers(df: DataFrame, column: str, by: Sequence[str], z: float = 4.0) -> DataFrame:
    """Adds ``z_score`` (population deviation; 0 counts as 1) and ``is_outlier``; nothing is removed."""
    out = group_z(df, column, by)
    score = (F.col(column) - F.col("_mean")) / F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"z_score": score, "is_outlier": F.coalesce((F.abs(score) > z).cast("int"), F.lit(0))}).drop("_mean", "_sd")


def seasonal_z(df: DataFrame, column: str, by: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Adds ``seasonal_z`` (sample deviation; none or 0 gives 0) and ``is_seasonal_anomaly``."""
    out = group_z(df, column, by, ddof=1)
    score = F.coalesce((F.col(column) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"seasonal_z": score, "is_seasonal_anomaly": (F.abs(score) > limit).cast("int")}).drop("_mean", "_sd")


def clean_readings(raw: DataFrame, ranges: Mapping[str, tuple[float, float]], labels: Sequence[str], outlier_z: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Cleaned readings and the log of what was done, one row of counts.

    In this order: repeated ids out (the first to arrive stays), impossible values
    voided, weather folded onto ``labels`` and filled from the hour, gaps filled
    from (segment, weekday, hour) and then from all, congestion outliers flagged.
    """
    arrival = [c for c in ("received_at", "timestamp", "segment_id") if c in raw.columns]
    here = [c for c in ranges if c in raw.columns]
    once = dedup_keep_first(raw, ["reading_id"], [*arrival, *here])
    voided = cut(fold_column(void_ranges(once, ranges), "weather", labels, "weather_label").drop("weather").withColumnRenamed("weather_label", "weather"))
    rows = voided.withColumn("hour_ts", F.date_trunc("hour", "timestamp"))
    rows = fill_group_mode(rows, "weather", "hour_ts", "Clear").drop("hour_ts").withColumns({"_dow": F.weekday("timestamp"), "_hour": F.hour("timestamp")})
    rows = fill_group_median(rows, here, ["segment_id", "_dow", "_hour"]).drop("_dow", "_hour")
    out = cut(flag_outliers(rows, "congestion_index", ["segment_id"], outlier_z))
    missing = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in here), F.lit(0))
    before = raw.agg(F.count(F.lit(1)).alias("rows_in"))
    unique = once.agg(F.count(F.lit(1)).alias("_once"), *[x.alias(f"_v{i}") for i, x in enumerate(count_void(once, {c: ranges[c] for c in here}))])
    gaps = voided.agg(F.sum(F.col("weather").isNull().cast("bigint")).alias("weather_missing"), missing.alias("imputed"))
    after = out.agg(F.sum("is_outlier").alias("outliers"), F.count(F.lit(1)).alias("rows_out"))
    one = {"_one": F.lit(1)}
    log = before.withColumns(one)
    for part in (unique, gaps, after):
        log = log.join(F.broadcast(part.withColumns(one)), "_one")  # one row each
    voids = sum((F.col(f"_v{i}") for i in range(len(here))), F.lit(0))
    return out, log.select("rows_in", (F.col("rows_in") - F.col("_once")).alias("duplicates"), voids.alias("voided"), "weather_missing", "imputed", "outliers", "rows_out")
