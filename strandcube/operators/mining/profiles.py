"""Entity profiles for clustering: one pass of conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact_avg
from strandcube.functions.values import present, ratio
from strandcube.operators.mining.evaluate import rank_fraction


def segment_profiles(base: DataFrame, group: list[str]) -> DataFrame:
    """Per segment: mean and 95th percentile of congestion, rush-hour, weekend and wet contrasts, incidents per 1000 rows, mean speed ratio.

    ``base`` has congestion_index, speed_ratio, is_congested, incident_count, is_peak_hour, is_weekend, is_adverse.
    """
    c = F.col("congestion_index")
    part = lambda flag, v: exact_avg(F.when(F.col(flag) == v, c))
    out = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), exact_avg(c).alias("mean_congestion"), F.percentile(c, F.lit(0.95)).alias("p95_congestion"), exact_avg(F.col("is_congested")).alias("congested_share"),
        F.coalesce(F.sum("incident_count"), F.lit(0)).alias("incident_total"), part("is_peak_hour", 1).alias("_pk"), part("is_peak_hour", 0).alias("_op"),
        part("is_weekend", 1).alias("_we"), part("is_weekend", 0).alias("_wd"), part("is_adverse", 1).alias("_wet"), part("is_adverse", 0).alias("_dry"),
        exact_avg(present(F.col("speed_ratio"))).alias("_sr"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        *group, "n_rows", "mean_congestion", F.round("p95_congestion", 8).alias("p95_congestion"), "congested_share", "incident_total", zero(ratio(F.col("_pk"), F.col("_op"))).alias("peak_ratio"), zero(ratio(F.col("_we"), F.col("_wd"))).alias("weekend_ratio"),
        zero(F.col("_wet") - F.col("_dry")).alias("wet_penalty"), ratio(F.col("incident_total").cast("double") * 1000, F.col("n_rows")).alias("incidents_per_1k"),
        zero(F.col("_sr")).alias("avg_speed_ratio"),
    )


# The names of clusters, in the order in which they are tried.
NAMES = ("Chronic peak-hour bottleneck", "All-day saturated corridor", "Commuter-driven corridor", "Incident-prone but free-flowing", "Stable low-stress segment")


def cluster_summary(rows: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Per cluster: its segments, the means of the features, and a name.

    A cluster is named by where it stands among the others: congestion by its
    average rank, the rush-hour ratio against the median and the 0.6 quantile of
    the clusters, incidents against their 0.75 quantile. One row per cluster, so
    the ranks are taken in one task.
    """
    out = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("segments"), *[F.round(F.avg(c), 4).alias(c) for c in features])
    ranked = rank_fraction(out, "mean_congestion", "_rank")
    every = Window.partitionBy(F.lit(1))
    at = lambda c, q: F.percentile(c, F.lit(q)).over(every)
    peaky, risky = F.col("peak_ratio"), F.col("incidents_per_1k")
    ranked = ranked.withColumns({"_p5": at("peak_ratio", 0.5), "_p6": at("peak_ratio", 0.6), "_i75": at("incidents_per_1k", 0.75)})
    high = F.col("_rank") >= 0.75
    name = F.when(high & (peaky >= F.col("_p5")), NAMES[0]).when(high, NAMES[1]).when((F.col("_rank") >= 0.4) & (peaky >= F.col("_p6")), NAMES[2]).when(risky >= F.col("_i75"), NAMES[3]).otherwise(NAMES[4])
    return ranked.select(cluster, "segments", *features, name.alias("label"))


def hotspots(profiles: DataFrame, n: int = 10) -> DataFrame:
    """The n segments of the greatest mean congestion; ties go by segment."""
    return profiles.orderBy(F.desc("mean_congestion"), "segment_id").limit(n)
