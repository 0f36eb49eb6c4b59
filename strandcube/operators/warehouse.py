"""Star-schema loading: dimensions with surrogate keys, facts, day calendar, integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.calendar import calendar_parts, congestion_level, is_congested, time_key
from strandcube.functions.values import clip, ratio

# Weather that counts as adverse, and categories of incident types.
ADVERSE = ("Fog", "Heavy Rain", "Rain")
CATEGORIES = {"Collision": "Accident", "Pedestrian": "Accident", "Breakdown": "Obstruction", "Debris": "Obstruction", "Signal Failure": "Obstruction", "Road Work": "Planned"}


def surrogate(df: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Keys 1..n in the order of the natural key. For dimensions: they are small, so one sorted task numbers them."""
    return df.withColumn(key, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*natural)).cast("bigint"))


def hashed_key(columns: Sequence[str]) -> Column:
    """A key for facts that needs no order over all rows: 64 bits of the natural key."""
    return F.xxhash64(*columns)


def dim_time(*stamps: DataFrame) -> DataFrame:
    """One row per distinct hour of one-column frames of timestamps."""
    hours = None
    for df in stamps:
        one = df.select(F.date_trunc("hour", F.col(df.columns[0])).alias("timestamp"))
        hours = one if hours is None else hours.unionByName(one)
    hours = hours.where(F.col("timestamp").isNotNull()).distinct()
    return hours.select(time_key(F.col("timestamp")).alias("time_key"), "timestamp", *[e.alias(n) for n, e in calendar_parts(F.col("timestamp")).items()])


def dim_labels(values: DataFrame, name: str, key: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct non-null labels of a one-column frame with surrogate keys and derived columns."""
    labels = values.select(F.col(values.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
    return surrogate(labels, [name], key).withColumns(dict(extra or {})).select(key, name, *(extra or {}))


def category(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), label), F.lit("Other"))


def dim_date(days: DataFrame) -> DataFrame:
    """A gap-free calendar from the first to the last day of a one-column frame; here weeks start with Monday 1."""
    span = days.agg(F.min(days.columns[0]).alias("a"), F.max(days.columns[0]).alias("b")).where("a IS NOT NULL")
    d = span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"), F.expr("interval 1 day"))).alias("date"))
    dow = F.weekday("date") + 1
    return d.select(
        F.date_format("date", "yyyyMMdd").cast("bigint").alias("date_key"), "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"),
        F.concat(F.lit("Q"), F.quarter("date").cast("string")).alias("quarter_name"), F.month("date").alias("month"), F.date_format("date", "MMMM").alias("month_name"),
        F.date_format("date", "yyyy-MM").alias("year_month"), F.weekofyear("date").alias("week_of_year"), dow.alias("day_of_week"), F.date_format("date", "EEEE").alias("day_name"),
        (dow >= 6).cast("int").alias("is_weekend"),
    )


def lookup_keys(fact: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], broadcast_rows: int = 500_000) -> DataFrame:
    """Left-joins (dimension, natural key, surrogate key) onto the fact; small dimensions are broadcast after a count."""
    out = fact
    for dim, natural, key in lookups:
        d = dim.select(natural, key)
        out = out.join(F.broadcast(d) if d.limit(broadcast_rows + 1).count() <= broadcast_rows else d, natural, "left")
    return out


def traffic_ratios(speed: Column, limit: Column, count: Column, lanes: Column, length: Column) -> dict[str, Column]:
    """Speed against the limit (0 to 1.5), the delay that follows, vehicles per lane, and vehicle kilometres; NULL where a part is missing."""
    speed_ratio = F.round(clip(ratio(speed, limit.cast("double")), 0.0, 1.5), 6)
    return {
        "speed_ratio": speed_ratio, "delay_index": F.round(clip(1 - speed_ratio, 0.0, 1.0), 6),
        "flow_per_lane": F.round(ratio(count, lanes.cast("double")), 6), "vehicle_km": F.round(count * length, 6),
    }


def fact_traffic(base: DataFrame, segments: DataFrame, weathers: DataFrame) -> DataFrame:
    """Traffic facts of cleaned readings (with the segment's limit, lanes and length and the hour's ``incident_count``).

    Keys are looked up by name; a reading of no known segment or weather keeps a
    NULL key. ``traffic_key`` is a hash of the reading, so that no order over all
    rows is needed.
    """
    rows = lookup_keys(base, [(segments, "segment_id", "segment_key"), (weathers, "weather", "weather_key")])
    level, made = congestion_level(F.col("congestion_index")), traffic_ratios(*[F.col(c) for c in ("avg_speed_kmph", "speed_limit_kmph", "vehicle_count", "lanes", "length_km")])
    return rows.select(
        hashed_key(["reading_id"]).alias("traffic_key"), "reading_id", time_key(F.col("timestamp")).alias("time_key"), "segment_key", "weather_key", "vehicle_count", "avg_speed_kmph", "occupancy_pct", "travel_time_min",
        "congestion_index", level.alias("congestion_level"), *[e.alias(n) for n, e in made.items()], F.coalesce("incident_count", F.lit(0)).cast("bigint").alias("incident_count"), is_congested(F.col("congestion_index")).alias("is_congested"),
    )


def fact_incident(incidents: DataFrame, traffic: DataFrame, segments: DataFrame, weathers: DataFrame, types: DataFrame) -> DataFrame:
    """Incident facts with keys, the congestion of their segment and hour (the greatest, if there are several), and ``is_major``.

    Severities beyond 1 to 4 count as the nearest of them.
    """
    rows = lookup_keys(incidents, [(segments, "segment_id", "segment_key"), (weathers, "weather", "weather_key"), (types, "incident_type", "incident_type_key")])
    rows = rows.withColumns({"time_key": time_key(F.col("timestamp")), "severity": clip(F.col("severity"), 1, 4).cast("int")})
    context = traffic.where("segment_key IS NOT NULL AND time_key IS NOT NULL").groupBy("segment_key", "time_key").agg(F.max("congestion_index").alias("congestion_index"))
    rows = rows.drop("congestion_index").join(context, ["segment_key", "time_key"], "left")
    return rows.select(
        hashed_key(["incident_id"]).alias("incident_key"), "incident_id", "time_key", "segment_key", "weather_key", "incident_type_key", "severity", "vehicles_involved", "lanes_blocked", "casualties",
        "duration_min", "response_time_min", "congestion_index", (F.col("severity") >= 3).cast("int").alias("is_major"),
    )


def incidents_per_hour(incidents: DataFrame, segment: str, ts: str) -> DataFrame:
    """``segment, hour_ts`` with the incidents, greatest severity, blocked lanes and mean response time of the hour."""
    return incidents.where(F.col(segment).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(segment), F.date_trunc("hour", F.col(ts)).alias("hour_ts")).agg(
        F.count("incident_id").alias("incident_count"), F.max("severity").alias("max_severity"), F.sum("lanes_blocked").alias("total_lanes_blocked"), F.avg("response_time_min").alias("mean_response_time"))


def orphan_counts(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per (name, fact, key, dimension, key): ``check_name, n_orphans``, the fact rows whose non-null key has no parent."""
    out = None
    for name, fact, key, dim, dim_key in checks:
        keys = fact.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        bad = keys.join(dim.select(F.col(dim_key).alias("_k")), "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_orphans"))
        one = bad.select(F.lit(name).alias("check_name"), "n_orphans")
        out = one if out is None else out.unionByName(one)
    return out
