"""Synthetic road-traffic feeds made by Spark, with the defects the cleaning removes."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandcube.functions.values import clip

# Demand by hour and by weekday, weather with its odds and its penalty, road types with their odds, limits
# and hazards, zones, incident types with their odds, and the
# weights and thresholds of the severity score.
HOUR_PROFILE = (
    0.18, 0.12, 0.09, 0.09, 0.14, 0.30, 0.58, 0.86, 0.98, 0.82, 0.68, 0.66,
    0.70, 0.68, 0.66, 0.72, 0.88, 1.00, 0.95, 0.74, 0.56, 0.44, 0.34, 0.24,
)
DOW_PROFILE = (1.00, 1.02, 1.03, 1.04, 1.08, 0.82, 0.62)
WEATHER = ("Clear", "Cloudy", "Rain", "Heavy Rain", "Fog")
WEATHER_P = (0.52, 0.24, 0.14, 0.05, 0.05)
WEATHER_PENALTY = (0.0, 0.01, 0.07, 0.14, 0.10)
WEATHER_CARRY = 0.55
ROAD_TYPES = ("Highway", "Arterial", "Collector", "Residential")
ROAD_TYPE_WEIGHTS = (0.15, 0.35, 0.30, 0.20)
ROAD_TYPE_CAPACITY = (1900, 1100, 700, 380)
SPEED_LIMITS = (100, 60, 50, 30)
ROAD_HAZARD = (1.25, 1.0, 0.7, 0.45)
ZONES = ("North", "South", "East", "West", "Central")
INCIDENT_TYPES = ("Collision", "Breakdown", "Road Work", "Debris", "Signal Failure", "Pedestrian")
INCIDENT_P = (0.34, 0.24, 0.16, 0.12, 0.08, 0.06)
SEVERITY_WEIGHTS = {"blocked": 1.15, "vehicles": 0.42, "weather": 0.65, "load": 0.55, "collision": 0.50, "highway": 0.30, "rush": 0.25, "chance": 0.30}
SEVERITY_EDGES = (0.85, 1.55, 2.25)
# The shares of readings that lose a value, get an impossible one, change case or come twice, and of
# incidents that lose a time; and the impossible values.
DROPOUTS = {"avg_speed_kmph": 0.018, "occupancy_pct": 0.012, "vehicle_count": 0.008, "weather": 0.02}
SENTINELS = {"avg_speed_kmph": (0.004, -1.0), "occupancy_pct": (0.003, 150.0), "vehicle_count": (0.002, 999_999.0)}
SHOUTED, REPEATED = 0.06, 0.01
INCIDENT_GAPS = {"response_time_min": 0.03, "duration_min": 0.02}


def _u(seed: int, *cols: str) -> Column:
    """A uniform number in [0, 1) that depends on the keys only, so every run and partitioning agrees."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _pick(values: Sequence, u: Column, odds: Sequence[float] | None = None) -> Column:
    """The value whose stretch of the odds (by default all alike) holds ``u``."""
    if odds is None:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))
    out, upto = F.lit(values[-1]), 1.0
    for v, p in reversed(list(zip(values, odds, strict=True))[:-1]):
        upto = sum(odds[: values.index(v) + 1])
        out = F.when(u < upto, F.lit(v)).otherwise(out)
    return out


def _of(key: str, keys: Sequence, values: Sequence) -> Column:
    """The value that belongs to a key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in zip(keys, values, strict=True) for x in kv]), F.col(key))


def _noise(seed: int, *cols: str) -> Column:
    """About normal, mean 0 and deviation 1: four uniform numbers added up."""
    return (sum((_u(seed + 1000 * i, *cols) for i in range(1, 5)), F.lit(0.0)) - 2.0) * (3.0**0.5)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once per row, however often later ones use them (projections are not merged over the generator)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def segments(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    rows = spark.range(1, n + 1).withColumn("road_type", _pick(ROAD_TYPES, _u(seed, "id"), ROAD_TYPE_WEIGHTS))
    u = lambda k: _u(seed + k, "id")
    lanes = F.when(F.col("road_type") == "Highway", 3 + F.floor(u(6) * 3)).when(F.col("road_type") == "Arterial", 2 + F.floor(u(6) * 2)).otherwise(1 + F.floor(u(6) * 2))
    return rows.select(
        F.format_string("SEG%03d", "id").alias("segment_id"), F.format_string("Road %d", "id").alias("segment_name"), _pick(ZONES, u(1)).alias("zone"), "road_type", lanes.cast("int").alias("lanes"),
        F.round(0.4 + 6.1 * u(2), 2).alias("length_km"), _of("road_type", ROAD_TYPES, SPEED_LIMITS).alias("speed_limit_kmph"), (u(3) < 0.55).cast("int").alias("signalised"),
        F.round(12.72 + 0.36 * u(4), 5).alias("latitude"), F.round(77.41 + 0.36 * u(5), 5).alias("longitude"),
    )


def hours(spark: SparkSession, days: int, seed: int = 42, start: str = "2024-01-01") -> DataFrame:
    """The hours of the period with the weather of the whole city: each is drawn anew, or carries the one before it."""
    rows = spark.range(days * 24).select(F.col("id").alias("h"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(start).cast("timestamp")).alias("timestamp"))
    drawn = F.when((F.col("h") == 0) | (_u(seed + 7, "h") >= WEATHER_CARRY), _pick(WEATHER, _u(seed + 6, "h"), WEATHER_P))
    carried = F.last(drawn, ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("h"))  # a row per hour of the period
    return rows.withColumn("weather", carried)


def readings(spark: SparkSession, segs: DataFrame, days: int, seed: int = 42, start: str = "2024-01-01") -> DataFrame:
    """One clean reading per segment and hour, congested by demand, weather and the incidents that are being cleared."""
    rows = _demand(spark, segs, days, seed, start)
    load = F.col("_load")
    blocked = _struck(rows, seed).select("segment_id", F.explode("_span").alias("h"), "_hit", F.col("h").alias("_from"))
    blocked = blocked.groupBy("segment_id", "h").agg(F.max(F.col("_hit") * F.pow(F.lit(0.65), F.col("h") - F.col("_from"))).alias("_block"))
    rows = rows.join(blocked, ["segment_id", "h"], "left").withColumn("_block", F.coalesce("_block", F.lit(0.0)))
    room = 1 - F.least("_block", F.lit(0.9))
    ci = clip(load / room * 0.75 + F.col("_penalty") + 0.03 * _noise(seed + 8, "segment_id", "h"), 0.02, 1.0)
    rows = _once(rows, congestion_index=F.round(ci, 4))
    free = F.col("speed_limit_kmph") * 0.95
    speed = F.least(F.greatest(free * (1 - 0.82 * F.col("congestion_index")) + 2.0 * _noise(seed + 9, "segment_id", "h"), F.lit(3.0)), free)
    rows = _once(rows, avg_speed_kmph=F.round(speed, 2))
    count = F.round(F.least(load, room) * F.col("_capacity") * (0.92 + 0.08 * _u(seed + 10, "segment_id", "h")))
    warm = 24 + 7 * F.sin((F.col("h") - 2400) / 1400.0) + 4 * F.sin((F.hour("timestamp") - 9) / 24.0 * 2 * pi) + 1.2 * _noise(seed + 17, "h")
    wet = F.when(F.col("weather") == "Heavy Rain", 15.0).when(F.col("weather") == "Rain", 5.0).otherwise(0.0) * 2 * _u(seed + 18, "h")
    return rows.select(
        F.concat_ws("-", "segment_id", F.lpad(F.col("h").cast("string"), 7, "0")).alias("reading_id"), "segment_id", "timestamp", count.alias("vehicle_count"), "avg_speed_kmph",
        F.round(clip(F.col("congestion_index") * 100 * (1 + 0.05 * _noise(seed + 19, "segment_id", "h")), 0.5, 99.5), 2).alias("occupancy_pct"), F.round(F.col("length_km") / F.greatest("avg_speed_kmph", F.lit(1.0)) * 60, 3).alias("travel_time_min"),
        "congestion_index", "weather", F.round(warm, 1).alias("temperature_c"), F.round(wet, 2).alias("precipitation_mm"), (F.col("_block") > 0).cast("int").alias("incident_active"),
    )


def _demand(spark: SparkSession, segs: DataFrame, days: int, seed: int, start: str) -> DataFrame:
    """Segments by hours with capacity, load and weather penalty."""
    keep = ["segment_id", "road_type", "lanes", "length_km", "speed_limit_kmph"]
    grid = segs.select(*keep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(days * 24 - 1).cast("bigint"))).alias("h")).join(hours(spark, days, seed, start), "h")
    profile = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), at + 1)
    trend = 1 + 0.12 * _u(seed + 20, "segment_id") * F.col("h") / (days * 24)
    popular = 0.55 + 0.6 * _u(seed + 21, "segment_id")
    load = popular * profile(HOUR_PROFILE, F.hour("timestamp")) * profile(DOW_PROFILE, F.weekday("timestamp")) * trend * clip(1 + 0.09 * _noise(seed + 22, "segment_id", "h"), 0.6, 1.5)
    return _once(grid, _capacity=_of("road_type", ROAD_TYPES, ROAD_TYPE_CAPACITY) * F.col("lanes"), _load=load, _penalty=_of("weather", WEATHER, WEATHER_PENALTY))


def _struck(rows: DataFrame, seed: int, rate: float = 0.02) -> DataFrame:
    """The hours with an incident (a hazard that rises with load and weather exceeds a uniform number), its attributes and the hours it lasts."""
    u = lambda k: _u(seed + k, "segment_id", "h")
    hazard = rate * (0.35 + 0.9 * F.least("_load", F.lit(2.0))) * (1 + 3.0 * F.col("_penalty")) * _of("road_type", ROAD_TYPES, ROAD_HAZARD)
    hit = rows.where(u(11) < F.least(hazard, F.lit(0.6))).withColumns({"incident_type": _pick(INCIDENT_TYPES, u(14), INCIDENT_P), "lanes_blocked": F.floor(u(15) * (F.col("lanes") + 1)).cast("int")})
    hit = hit.withColumn("vehicles_involved", clip(F.floor(3.2 * u(16)) + F.when(F.col("incident_type") == "Collision", 2).otherwise(1), 1, 9).cast("int"))
    crash = F.col("incident_type") == "Collision"
    parts = {
        "blocked": F.col("lanes_blocked") / F.greatest("lanes", F.lit(1)), "vehicles": (F.col("vehicles_involved") - 1) / 8, "weather": F.col("_penalty") / max(WEATHER_PENALTY), "load": F.col("_load"), "collision": crash.cast("int"),
        "highway": (F.col("road_type") == "Highway").cast("int"), "rush": F.hour("timestamp").isin(7, 8, 17, 18).cast("int"), "chance": _noise(seed + 23, "segment_id", "h"),
    }
    score = sum((w * parts[name] for name, w in SEVERITY_WEIGHTS.items()), F.lit(0.0))
    severity = F.lit(1) + sum(((score >= e).cast("int") for e in SEVERITY_EDGES), F.lit(0))
    hit = _once(hit, severity=severity)
    long = lambda k, shape, scale: -scale * shape / 2 * (F.log(1 - u(k)) + F.log(1 - u(k + 1)))
    hit = hit.withColumns({"duration_min": F.round(clip(long(24, 2.2, 9 + 11 * F.col("severity")), 5, 360), 1), "response_time_min": F.round(clip(long(26, 2.0, 3.0 + 1.6 * (5 - F.col("severity"))), 2, 75), 1)})
    casualties = F.when(crash, F.floor(F.col("severity") * 0.5 * u(28) + 0.25)).otherwise(0).cast("int")
    share = 0.20 + 0.55 * F.col("lanes_blocked") / F.greatest("lanes", F.lit(1)) + 0.10 * F.col("severity") / 4
    return hit.withColumns({"casualties": casualties, "_hit": share, "_span": F.sequence(F.col("h"), F.col("h") + F.greatest(F.ceil(F.col("duration_min") / 60), F.lit(1)) - 1)})


def incidents(spark: SparkSession, segs: DataFrame, days: int, seed: int = 42, start: str = "2024-01-01") -> DataFrame:
    """The incidents behind :func:`readings` of the same arguments."""
    hit = _struck(_demand(spark, segs, days, seed, start), seed)
    return hit.select(
        F.concat(F.lit("INC"), F.lpad(F.abs(F.xxhash64("segment_id", "h") % 10**12).cast("string"), 12, "0")).alias("incident_id"), "segment_id", "timestamp", "incident_type", "severity", "vehicles_involved", "lanes_blocked",
        "duration_min", "response_time_min", "weather", "casualties",
    )


def spoil(clean: DataFrame, seed: int = 42) -> DataFrame:
    """Dropouts, impossible values, shouted or missing labels and repeated rows."""
    u = lambda k: _u(seed + k, "reading_id")
    made = {}
    for i, c in enumerate(DROPOUTS):
        kept = F.col(c)
        if c in SENTINELS:
            share, value = SENTINELS[c]
            kept = F.when(u(40 + i) < share, F.lit(value)).otherwise(kept)
        elif c == "weather":
            kept = F.when(u(40 + i) < SHOUTED, F.upper(c)).otherwise(kept)
        made[c] = F.when(u(30 + i) >= DROPOUTS[c], kept)
    out = clean.withColumns(made)
    return out.unionByName(out.where(u(29) < REPEATED))


def spoil_incidents(clean: DataFrame, seed: int = 42) -> DataFrame:
    """Incidents without some of their times."""
    return clean.withColumns({c: F.when(_u(seed + 50 + i, "incident_id") >= p, F.col(c)) for i, (c, p) in enumerate(INCIDENT_GAPS.items())})
