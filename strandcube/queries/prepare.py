"""Cleaning, feature and warehouse queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcube.functions.calendar import (
    DURATION_BANDS,
    LANE_BANDS,
    RESPONSE_BANDS,
    VEHICLE_BANDS,
    add_time_features,
    band,
    congestion_level,
    is_congested,
)
from strandcube.functions.labels import entity_number, fold_column, fold_columns, vocabulary
from strandcube.functions.values import clip, present, ratio
from strandcube.operators.clean import clean_readings, count_void, dedup_keep_first, fill_group_median, fill_group_mode, flag_outliers, seasonal_z, void_ranges
from strandcube.operators.warehouse import ADVERSE, category, dim_date, dim_labels, dim_time, fact_incident, fact_traffic, incidents_per_hour, orphan_counts, surrogate
from strandcube.queries.common import T_SQL, davg, traffic
from strandcube.sources.tables import table

# The possible ranges of the readings.
RANGES = {"avg_speed_kmph": (0.0, 160.0), "occupancy_pct": (0.0, 100.0), "vehicle_count": (0.0, 20_000.0), "congestion_index": (0.0, 1.0)}


def dedup_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reading_id, the first to arrive."""
    rows = table(spark, sf_dir, "readings").select("reading_id", "segment_id", "received_at", "avg_speed_kmph")
    out = dedup_keep_first(rows, ["reading_id"], ["received_at", "segment_id", "avg_speed_kmph"])
    return out.select("reading_id", "segment_id", present(F.col("avg_speed_kmph")).alias("avg_speed_kmph"))


def void_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning log: rows, repeated ids, and per field values out of range and missing."""
    rows = table(spark, sf_dir, "readings")
    missing = [F.sum(present(F.col(c)).isNull().cast("bigint")).alias(f"n_missing_{c}") for c in RANGES]
    return rows.agg(F.count(F.lit(1)).alias("rows_in"), (F.count(F.lit(1)) - F.count_distinct("reading_id")).alias("n_repeated"), *count_void(rows, RANGES), *missing)


def voided_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = void_ranges(table(spark, sf_dir, "readings").select("reading_id", *RANGES), RANGES)
    return rows.agg(*[F.count(c).alias(f"n_{c}") for c in RANGES], *[F.max(c).alias(f"max_{c}") for c in RANGES], *[F.min(c).alias(f"min_{c}") for c in RANGES])


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vocabulary(table(spark, sf_dir, "dim_weather"), "weather")
    rows = table(spark, sf_dir, "readings").select("reading_id", F.date_trunc("hour", "timestamp").alias("hour_ts"), "weather")
    return fold_column(rows, "weather", labels, "weather_label").drop("weather").withColumnRenamed("weather_label", "weather")


def normalise_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per weather label after folding of spellings."""
    return _weather(spark, sf_dir).groupBy("weather").agg(F.count(F.lit(1)).alias("n"))


def fill_hour_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing weather from the hour's most frequent label, then Clear."""
    return fill_group_mode(_weather(spark, sf_dir), "weather", "hour_ts", "Clear").groupBy("weather").agg(F.count(F.lit(1)).alias("n"))


def impute_seasonal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing speeds and counts from the median of (segment, weekday, hour), then of all."""
    rows = void_ranges(table(spark, sf_dir, "readings").select("reading_id", "segment_id", "timestamp", "avg_speed_kmph", "vehicle_count"), RANGES)
    rows = rows.withColumns({"dow": F.weekday("timestamp"), "hour": F.hour("timestamp")})
    out = fill_group_median(rows, ["avg_speed_kmph", "vehicle_count"], ["segment_id", "dow", "hour"])
    return out.select("reading_id", "segment_id", F.round("avg_speed_kmph", 6).alias("avg_speed_kmph"), F.round("vehicle_count", 6).alias("vehicle_count"))


def impute_incident_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fact_incident").select("incident_key", "incident_type_key", "severity", present(F.col("duration_min")).alias("duration_min"), present(F.col("response_time_min")).alias("response_time_min"))
    out = fill_group_median(rows, ["duration_min", "response_time_min"], ["incident_type_key", "severity"])
    return out.select("incident_key", F.round("duration_min", 6).alias("duration_min"), F.round("response_time_min", 6).alias("response_time_min"))


def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings more than four deviations from their segment's mean, per segment."""
    rows = void_ranges(table(spark, sf_dir, "readings").select("segment_id", "congestion_index"), RANGES)
    return flag_outliers(rows, "congestion_index", ["segment_id"]).groupBy("segment_id").agg(F.sum("is_outlier").alias("n_outliers"), F.round(F.max("z_score"), 6).alias("max_z"))


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_time_features(table(spark, sf_dir, "fact_traffic").select("time_key").distinct().join(table(spark, sf_dir, "dim_time").select("time_key", "timestamp"), "time_key"), "timestamp")
    cols = ["time_key", "year", "quarter", "month", "month_name", "week_of_year", "day_of_month", "day_of_week", "day_name", "hour", "is_weekend", "is_peak_hour", "time_of_day"]
    return rows.select(*cols)


def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_time_features(table(spark, sf_dir, "dim_time").select("time_key", "timestamp"), "timestamp")
    return rows.select("time_key", *[(F.round(c, 6) + 0.0).alias(c) for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])


def discretise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("congestion_index")
    rows = traffic(spark, sf_dir).select(congestion_level(c).alias("level"), is_congested(c).alias("congested"))
    return rows.groupBy("level", "congested").agg(F.count(F.lit(1)).alias("n"))


def band_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fact_incident")
    bands = {"duration_band": ("duration_min", DURATION_BANDS), "response_band": ("response_time_min", RESPONSE_BANDS), "lanes_band": ("lanes_blocked", LANE_BANDS), "vehicles_band": ("vehicles_involved", VEHICLE_BANDS)}
    rows = f.select(*[band(F.col(c), b, 0 if n == "vehicles_band" else -1).alias(n) for n, (c, b) in bands.items()])
    return rows.groupBy(*bands).agg(F.count(F.lit(1)).alias("n"))


def analytical_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with segment attributes, the hour's incidents (none = 0) and clipped ratios."""
    seg = table(spark, sf_dir, "dim_segment").select("segment_key", "zone", "speed_limit_kmph", "lanes", "length_km")
    inc = table(spark, sf_dir, "fact_incident").where("segment_key IS NOT NULL AND time_key IS NOT NULL")
    per_hour = inc.groupBy(F.col("segment_key").alias("_s"), F.col("time_key").alias("_t")).agg(F.count("incident_id").alias("n_incidents"), F.max("severity").alias("max_severity"))
    t = traffic(spark, sf_dir).select("traffic_key", "segment_key", "time_key", "avg_speed_kmph", "vehicle_count")
    rows = t.join(seg, "segment_key", "left").join(per_hour, (F.col("segment_key") == F.col("_s")) & (F.col("time_key") == F.col("_t")), "left")
    return rows.select(
        "traffic_key", "zone", F.coalesce("n_incidents", F.lit(0)).alias("n_incidents"), F.coalesce("max_severity", F.lit(0)).alias("max_severity"),
        F.round(clip(ratio(present(F.col("avg_speed_kmph")), F.col("speed_limit_kmph").cast("double")), 0.02, 1.3), 6).alias("speed_ratio"),
        F.round(ratio(present(F.col("vehicle_count")), F.col("lanes").cast("double")), 6).alias("flow_per_lane"),
    )


def incident_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the traffic of their segment and hour; those without any are dropped."""
    t = traffic(spark, sf_dir).where("segment_key IS NOT NULL AND time_key IS NOT NULL AND congestion_index IS NOT NULL")
    context = t.groupBy("segment_key", "time_key").agg(F.max("congestion_index").alias("context_congestion"))
    f = table(spark, sf_dir, "fact_incident").select("incident_key", "segment_key", "time_key", "severity", "duration_min")
    rows = f.join(context, ["segment_key", "time_key"])
    return rows.select("incident_key", "severity", "duration_min", "context_congestion", congestion_level(F.col("context_congestion")).alias("context_level"))


def dim_time_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = table(spark, sf_dir, "readings").select("timestamp"), table(spark, sf_dir, "incidents").select("timestamp")
    return dim_time(r, i).drop("date", "timestamp")


def dim_segment_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dim_segment").select("segment_id", "zone", "road_type")
    return surrogate(rows, ["segment_id"], "new_key").select("new_key", "segment_id", "zone", "road_type")


def dim_weather_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_labels(_weather(spark, sf_dir).select("weather"), "weather", "new_key", {"adverse": F.col("weather").isin(*ADVERSE).cast("int")})


def dim_incident_type_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dim_incident_type").select("incident_type")
    return dim_labels(rows, "incident_type", "new_key", {"new_category": category(F.col("incident_type"))})


def dim_date_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_date(table(spark, sf_dir, "dim_time").select("date")).drop("date")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dim_segment").select("segment_key", "segment_id", "speed_limit_kmph", "lanes", "length_km", entity_number(F.col("segment_id")).alias("_number"))


def _incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per incident, as it was received last, with folded labels and the segment's own spelling."""
    cols = ["incident_id", "segment_id", "timestamp", "incident_type", "severity", "vehicles_involved", "lanes_blocked", "duration_min", "response_time_min", "weather", "casualties", "received_at"]
    raw = table(spark, sf_dir, "incidents").select(*cols).where("incident_id IS NOT NULL")
    vocabularies = {"weather": vocabulary(table(spark, sf_dir, "dim_weather"), "weather"), "incident_type": vocabulary(table(spark, sf_dir, "dim_incident_type"), "incident_type")}
    rows = fold_columns(raw, vocabularies).drop(*vocabularies).withColumnsRenamed({f"{c}_label": c for c in vocabularies})
    rows = rows.withColumn("_number", entity_number(F.col("segment_id"))).drop("segment_id").join(F.broadcast(_segments(spark, sf_dir).select("segment_id", "_number").where("_number IS NOT NULL").dropDuplicates(["_number"])), "_number", "left").drop("_number")
    rest = [c for c in rows.columns if c not in ("incident_id", "received_at")]
    last = F.max(F.struct("received_at", *[present(F.col(c)).alias(c) if c in ("duration_min", "response_time_min") else F.col(c) for c in rest])).alias("_x")
    return rows.groupBy("incident_id").agg(last).select("incident_id", *[F.col(f"_x.{c}").alias(c) for c in rest])


def fact_traffic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traffic fact of the readings: keys, measures voided where impossible, ratios, level and the hour's incidents."""
    segments, weathers = _segments(spark, sf_dir), table(spark, sf_dir, "dim_weather").select("weather", "weather_key")
    cols = ["reading_id", "segment_id", "timestamp", "received_at", "vehicle_count", "avg_speed_kmph", "occupancy_pct", "travel_time_min", "congestion_index", "weather"]
    raw = dedup_keep_first(table(spark, sf_dir, "readings").select(*cols), ["reading_id"], ["received_at", "segment_id", "timestamp", *RANGES, "weather"])
    rows = fold_column(void_ranges(raw, RANGES), "weather", vocabulary(weathers, "weather"), "weather_label").drop("weather").withColumnRenamed("weather_label", "weather")
    rows = rows.withColumns({"hour_ts": F.date_trunc("hour", "timestamp"), "travel_time_min": present(F.col("travel_time_min"))})
    hours = incidents_per_hour(_incident_log(spark, sf_dir), "segment_id", "timestamp").select("segment_id", "hour_ts", "incident_count")
    rows = rows.join(segments.select("segment_id", "speed_limit_kmph", "lanes", "length_km"), "segment_id", "left").join(hours, ["segment_id", "hour_ts"], "left")
    return fact_traffic(rows, segments, weathers).drop("traffic_key")


def fact_incident_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident fact of the incident log, with the congestion that fact_traffic shows for its segment and hour."""
    segments, weathers, types = _segments(spark, sf_dir), table(spark, sf_dir, "dim_weather"), table(spark, sf_dir, "dim_incident_type")
    return fact_incident(_incident_log(spark, sf_dir), traffic(spark, sf_dir), segments, weathers, types).drop("incident_key")


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of cleaning the readings: repeats, voided and filled values, outliers."""
    raw = table(spark, sf_dir, "readings").select("reading_id", "segment_id", "timestamp", "received_at", "weather", *RANGES)
    return clean_readings(raw, RANGES, vocabulary(table(spark, sf_dir, "dim_weather"), "weather"))[1]


def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = table(spark, sf_dir, "fact_traffic"), table(spark, sf_dir, "fact_incident")
    seg, time, wea = (table(spark, sf_dir, x) for x in ("dim_segment", "dim_time", "dim_weather"))
    return orphan_counts([("traffic.segment", t, "segment_key", seg, "segment_key"), ("traffic.time", t, "time_key", time, "time_key"), ("traffic.weather", t, "weather_key", wea, "weather_key"), ("incident.segment", i, "segment_key", seg, "segment_key")])


def seasonal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over three deviations from their (segment, weekday, hour), and their rate, per zone."""
    from strandcube.queries.common import traffic_cube

    rows = traffic_cube(spark, sf_dir).star(["zone", "day_name", "hour"]).where("congestion_index IS NOT NULL")
    z = seasonal_z(rows, "congestion_index", ["segment_key", "day_name", "hour"])
    return z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("is_seasonal_anomaly").alias("n_flagged"), (F.sum("is_seasonal_anomaly").cast("double") * 100 / F.count(F.lit(1))).alias("pct_flagged"))


QUERIES = {f.__name__: f for f in (
    dedup_readings, void_and_count, voided_readings, normalise_weather, fill_hour_mode, impute_seasonal_median, impute_incident_median, outlier_flags, calendar_features, cyclical_features,
    discretise_levels, band_labels, analytical_base, incident_features, dim_time_build, dim_segment_build, dim_weather_build, dim_incident_type_build, dim_date_build, fact_traffic_build, fact_incident_build, clean_log, fk_check, seasonal_flags)}

_V = {c: f"CASE WHEN {c} BETWEEN {lo:g} AND {hi:g} THEN {c} END" for c, (lo, hi) in RANGES.items()}
_FOLD = "lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'))"
_WEATHER = f"""
vocab AS (SELECT weather AS label, lower(regexp_replace(weather, '[^A-Za-z0-9]', '', 'g')) AS k FROM dim_weather),
named AS (
  SELECT raw, label FROM (SELECT DISTINCT weather AS raw, {_FOLD.replace('raw', 'weather')} AS f FROM readings WHERE weather IS NOT NULL), vocab
  WHERE f = k OR (f NOT IN ('', 'na', 'nan', 'null', 'none', 'nil', 'unknown', 'notreported', 'notavailable', 'missing', 'tbc', 'tbd', 'other', 'undefined') AND f NOT IN (SELECT k FROM vocab)
    AND (levenshtein(f, k) = 1 OR (levenshtein(f, k) = 2 AND (length(k) >= 8 OR (length(f) = length(k) AND list_sort(string_split(f, '')) = list_sort(string_split(k, '')))))))
  QUALIFY row_number() OVER (PARTITION BY raw ORDER BY levenshtein(f, k), label) = 1),
wr AS (SELECT r.*, n.label, date_trunc('hour', r.timestamp) AS hour_ts FROM readings r LEFT JOIN named n ON r.weather = n.raw)"""
_LOG = """
lv AS (SELECT 'weather' AS field, weather AS label, lower(regexp_replace(weather, '[^A-Za-z0-9]', '', 'g')) AS k FROM dim_weather UNION SELECT 'incident_type', incident_type, lower(regexp_replace(incident_type, '[^A-Za-z0-9]', '', 'g')) FROM dim_incident_type),
lr AS (SELECT DISTINCT field, raw, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS f FROM (SELECT 'weather' AS field, weather AS raw FROM incidents UNION SELECT 'incident_type', incident_type FROM incidents) WHERE raw IS NOT NULL),
ln AS (SELECT lr.field, lr.raw, lv.label FROM lr JOIN lv ON lr.field = lv.field
  WHERE f = k OR (f NOT IN ('', 'na', 'nan', 'null', 'none', 'nil', 'unknown', 'notreported', 'notavailable', 'missing', 'tbc', 'tbd', 'other', 'undefined') AND f NOT IN (SELECT k FROM lv x WHERE x.field = lr.field)
    AND (levenshtein(f, k) = 1 OR (levenshtein(f, k) = 2 AND (length(k) >= 8 OR (length(f) = length(k) AND list_sort(string_split(f, '')) = list_sort(string_split(k, '')))))))
  QUALIFY row_number() OVER (PARTITION BY lr.field, lr.raw ORDER BY levenshtein(f, k), lv.label) = 1),
li AS (SELECT i.incident_id, i.received_at, i.timestamp, i.severity, i.vehicles_involved, i.lanes_blocked, CASE WHEN NOT isnan(i.duration_min) THEN i.duration_min END AS duration_min,
    CASE WHEN NOT isnan(i.response_time_min) THEN i.response_time_min END AS response_time_min, i.casualties, a.label AS weather, b.label AS incident_type, s.segment_id
  FROM incidents i LEFT JOIN ln a ON a.field = 'weather' AND a.raw = i.weather LEFT JOIN ln b ON b.field = 'incident_type' AND b.raw = i.incident_type
  LEFT JOIN dim_segment s ON TRY_CAST(regexp_extract(s.segment_id, '(\\d+)', 1) AS BIGINT) = TRY_CAST(regexp_extract(i.segment_id, '(\\d+)', 1) AS BIGINT) WHERE i.incident_id IS NOT NULL),
log AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY received_at DESC NULLS LAST, timestamp DESC NULLS LAST, severity DESC NULLS LAST, vehicles_involved DESC NULLS LAST, lanes_blocked DESC NULLS LAST,
  duration_min DESC NULLS LAST, response_time_min DESC NULLS LAST, casualties DESC NULLS LAST, weather DESC NULLS LAST, incident_type DESC NULLS LAST, segment_id DESC NULLS LAST) = 1)"""
_CAL = """CAST(year(ts) AS INT) AS year, CAST(quarter(ts) AS INT) AS quarter, CAST(month(ts) AS INT) AS month, monthname(ts) AS month_name, CAST(weekofyear(ts) AS INT) AS week_of_year,
  CAST(day(ts) AS INT) AS day_of_month, CAST(isodow(ts) - 1 AS INT) AS day_of_week, dayname(ts) AS day_name, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
  CAST(hour(ts) IN (7, 8, 9, 17, 18, 19) AS INT) AS is_peak_hour,
  CASE WHEN hour(ts) <= 5 THEN 'Night' WHEN hour(ts) <= 11 THEN 'Morning' WHEN hour(ts) <= 16 THEN 'Afternoon' WHEN hour(ts) <= 20 THEN 'Evening' ELSE 'Late Evening' END AS time_of_day"""
_LEVEL = "CASE WHEN {c} < 0 OR {c} > 1.01 THEN NULL WHEN {c} <= 0.35 THEN 'Free flow' WHEN {c} <= 0.6 THEN 'Light' WHEN {c} <= 0.8 THEN 'Moderate' WHEN {c} <= 1.01 THEN 'Severe' END"


def _bands(c: str, bands, above: float) -> str:
    return f"CASE WHEN {c} <= {above} OR isnan(CAST({c} AS DOUBLE)) THEN NULL " + " ".join(f"WHEN {c} <= {e} THEN '{t}'" for e, t in bands) + " END"


def _orphan(name: str, fact: str, key: str, dim: str) -> str:
    return f"SELECT '{name}' AS check_name, count(*) AS n_orphans FROM {fact} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {dim})"


SQL = {
    "dedup_readings": """SELECT reading_id, segment_id, CASE WHEN NOT isnan(avg_speed_kmph) THEN avg_speed_kmph END AS avg_speed_kmph FROM readings
QUALIFY row_number() OVER (PARTITION BY reading_id ORDER BY received_at NULLS FIRST, segment_id NULLS FIRST, avg_speed_kmph NULLS FIRST) = 1""",
    "void_and_count": "SELECT count(*) AS rows_in, count(*) - count(DISTINCT reading_id) AS n_repeated, "
    + ", ".join(f"count(*) FILTER (NOT isnan({c}) AND NOT {c} BETWEEN {lo:g} AND {hi:g}) AS n_void_{c}" for c, (lo, hi) in RANGES.items())
    + ", "
    + ", ".join(f"count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_missing_{c}" for c in RANGES)
    + " FROM readings",
    "voided_readings": "SELECT " + ", ".join(f"count({v}) AS n_{c}, max({v}) AS max_{c}, min({v}) AS min_{c}" for c, v in _V.items()) + " FROM readings",
    "normalise_weather": f"WITH {_WEATHER} SELECT label AS weather, count(*) AS n FROM wr GROUP BY ALL",
    "fill_hour_mode": f"""WITH {_WEATHER}, c AS (SELECT hour_ts, label, count(*) AS n FROM wr WHERE label IS NOT NULL GROUP BY ALL),
m AS (SELECT hour_ts, label AS mode FROM c QUALIFY row_number() OVER (PARTITION BY hour_ts ORDER BY n DESC, label) = 1)
SELECT coalesce(label, mode, 'Clear') AS weather, count(*) AS n FROM wr LEFT JOIN m USING (hour_ts) GROUP BY ALL""",
    "impute_seasonal_median": f"""WITH v AS (SELECT reading_id, segment_id, isodow(timestamp) AS dow, hour(timestamp) AS h, {_V['avg_speed_kmph']} AS s, {_V['vehicle_count']} AS c FROM readings),
m AS (SELECT segment_id, dow, h, median(s) AS ms, median(c) AS mc FROM v GROUP BY ALL),
f AS (SELECT reading_id, segment_id, coalesce(s, ms) AS s, coalesce(c, mc) AS c FROM v JOIN m USING (segment_id, dow, h)), o AS (SELECT median(s) AS os, median(c) AS oc FROM f)
SELECT reading_id, segment_id, round(coalesce(s, os), 6) AS avg_speed_kmph, round(coalesce(c, oc), 6) AS vehicle_count FROM f, o""",
    "impute_incident_median": """WITH v AS (SELECT incident_key, incident_type_key AS t, severity AS s, CASE WHEN NOT isnan(duration_min) THEN duration_min END AS d, CASE WHEN NOT isnan(response_time_min) THEN response_time_min END AS r FROM fact_incident),
m AS (SELECT t, s, median(d) AS md, median(r) AS mr FROM v GROUP BY ALL), f AS (SELECT incident_key, coalesce(d, md) AS d, coalesce(r, mr) AS r FROM v JOIN m ON v.t IS NOT DISTINCT FROM m.t AND v.s IS NOT DISTINCT FROM m.s), o AS (SELECT median(d) AS od, median(r) AS orr FROM f)
SELECT incident_key, round(coalesce(d, od), 6) AS duration_min, round(coalesce(r, orr), 6) AS response_time_min FROM f, o""",
    "outlier_flags": f"""WITH v AS (SELECT segment_id, {_V['congestion_index']} AS x FROM readings), g AS (SELECT segment_id, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY ALL),
z AS (SELECT segment_id, (x - m) / coalesce(nullif(sd, 0), 1) AS z FROM v JOIN g USING (segment_id))
SELECT segment_id, CAST(sum(CASE WHEN abs(z) > 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, round(max(z), 6) AS max_z FROM z GROUP BY ALL""",
    "calendar_features": f"SELECT time_key, {_CAL} FROM (SELECT time_key, timestamp AS ts FROM dim_time WHERE time_key IN (SELECT time_key FROM fact_traffic))",
    "cyclical_features": "SELECT time_key, " + ", ".join(f"round({f}({part} * 2 * pi() / {n}), 6) + 0.0 AS {name}_{f}" for name, part, n in (("hour", "hour(timestamp)", 24), ("dow", "(isodow(timestamp) - 1)", 7)) for f in ("sin", "cos")) + " FROM dim_time",
    "discretise_levels": f"WITH {T_SQL} SELECT {_LEVEL.format(c='congestion_index')} AS level, CAST(congestion_index >= 0.6 AS INT) AS congested, count(*) AS n FROM t GROUP BY ALL",
    "band_labels": f"SELECT {_bands('duration_min', DURATION_BANDS, -1)} AS duration_band, {_bands('response_time_min', RESPONSE_BANDS, -1)} AS response_band, {_bands('lanes_blocked', LANE_BANDS, -1)} AS lanes_band, {_bands('vehicles_involved', VEHICLE_BANDS, 0)} AS vehicles_band, count(*) AS n FROM fact_incident GROUP BY ALL",
    "analytical_base": """WITH i AS (SELECT segment_key, time_key, count(incident_id) AS n, max(severity) AS s FROM fact_incident WHERE segment_key IS NOT NULL AND time_key IS NOT NULL GROUP BY ALL)
SELECT traffic_key, zone, coalesce(n, 0) AS n_incidents, coalesce(s, 0) AS max_severity,
  CASE WHEN avg_speed_kmph IS NOT NULL AND NOT isnan(avg_speed_kmph) AND speed_limit_kmph <> 0 THEN round(least(greatest(avg_speed_kmph / speed_limit_kmph, 0.02), 1.3), 6) END AS speed_ratio,
  round(CASE WHEN NOT isnan(vehicle_count) THEN vehicle_count END / nullif(lanes, 0), 6) AS flow_per_lane
FROM fact_traffic LEFT JOIN dim_segment USING (segment_key) LEFT JOIN i USING (segment_key, time_key)""",
    "incident_features": f"""WITH {T_SQL}, c AS (SELECT segment_key, time_key, max(congestion_index) AS x FROM t WHERE congestion_index IS NOT NULL GROUP BY ALL)
SELECT incident_key, severity, duration_min, x AS context_congestion, {_LEVEL.format(c='x')} AS context_level FROM fact_incident JOIN c USING (segment_key, time_key)""",
    "dim_time_build": f"SELECT CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) AS time_key, {_CAL} FROM (SELECT date_trunc('hour', timestamp) AS ts FROM readings UNION SELECT date_trunc('hour', timestamp) FROM incidents) WHERE ts IS NOT NULL",
    "dim_segment_build": "SELECT row_number() OVER (ORDER BY segment_id) AS new_key, segment_id, zone, road_type FROM dim_segment",
    "dim_weather_build": f"WITH {_WEATHER} SELECT row_number() OVER (ORDER BY weather) AS new_key, weather, CAST(weather IN ('Fog', 'Heavy Rain', 'Rain') AS INT) AS adverse FROM (SELECT DISTINCT label AS weather FROM wr WHERE label IS NOT NULL)",
    "dim_incident_type_build": """SELECT row_number() OVER (ORDER BY incident_type) AS new_key, incident_type, CASE WHEN incident_type IN ('Collision', 'Pedestrian') THEN 'Accident'
  WHEN incident_type IN ('Breakdown', 'Debris', 'Signal Failure') THEN 'Obstruction' WHEN incident_type = 'Road Work' THEN 'Planned' ELSE 'Other' END AS new_category FROM (SELECT DISTINCT incident_type FROM dim_incident_type)""",
    "dim_date_build": """SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, 'Q' || quarter(d) AS quarter_name, CAST(month(d) AS INT) AS month,
  monthname(d) AS month_name, strftime(d, '%Y-%m') AS year_month, CAST(weekofyear(d) AS INT) AS week_of_year, CAST(isodow(d) AS INT) AS day_of_week, dayname(d) AS day_name, CAST(isodow(d) >= 6 AS INT) AS is_weekend
FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM dim_time)""",
    "fact_traffic_build": f"""WITH {_WEATHER}, {_LOG},
i AS (SELECT segment_id, date_trunc('hour', timestamp) AS hour_ts, count(incident_id) AS n FROM log WHERE segment_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY ALL),
d AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY reading_id ORDER BY received_at NULLS FIRST, segment_id NULLS FIRST, timestamp NULLS FIRST, {', '.join(f'{c} NULLS FIRST' for c in RANGES)}, weather NULLS FIRST) = 1),
v AS (SELECT reading_id, segment_id, timestamp, hour_ts, label, {', '.join(f'{e} AS {c}' for c, e in _V.items())}, CASE WHEN NOT isnan(travel_time_min) THEN travel_time_min END AS travel_time_min FROM d),
r AS (SELECT v.*, segment_key, weather_key, round(least(greatest(avg_speed_kmph / nullif(speed_limit_kmph, 0), 0), 1.5), 6) AS speed_ratio, lanes, length_km, n
  FROM v LEFT JOIN dim_segment s ON s.segment_id = v.segment_id LEFT JOIN dim_weather w ON w.weather = v.label LEFT JOIN i ON i.segment_id = v.segment_id AND i.hour_ts = v.hour_ts)
SELECT reading_id, CAST(strftime(timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, segment_key, weather_key, vehicle_count, avg_speed_kmph, occupancy_pct, travel_time_min, congestion_index, {_LEVEL.format(c='congestion_index')} AS congestion_level,
  CASE WHEN avg_speed_kmph IS NOT NULL THEN speed_ratio END AS speed_ratio, CASE WHEN avg_speed_kmph IS NOT NULL AND speed_ratio IS NOT NULL THEN round(least(greatest(1 - speed_ratio, 0), 1), 6) END AS delay_index,
  round(vehicle_count / nullif(lanes, 0), 6) AS flow_per_lane, round(vehicle_count * length_km, 6) AS vehicle_km, coalesce(n, 0) AS incident_count, CAST(congestion_index >= 0.6 AS INT) AS is_congested FROM r""",
    "fact_incident_build": f"""WITH {_LOG}, {T_SQL}, c AS (SELECT segment_key, time_key, max(congestion_index) AS congestion_index FROM t WHERE segment_key IS NOT NULL AND time_key IS NOT NULL GROUP BY ALL),
k AS (SELECT log.*, CAST(strftime(log.timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, s.segment_key, w.weather_key, y.incident_type_key FROM log LEFT JOIN dim_segment s ON s.segment_id = log.segment_id LEFT JOIN dim_weather w ON w.weather = log.weather LEFT JOIN dim_incident_type y ON y.incident_type = log.incident_type)
SELECT incident_id, k.time_key, k.segment_key, weather_key, incident_type_key, CASE WHEN severity IS NOT NULL THEN CAST(least(greatest(severity, 1), 4) AS INT) END AS severity, vehicles_involved, lanes_blocked, casualties, duration_min, response_time_min, congestion_index,
  CAST(severity >= 3 AS INT) AS is_major FROM k LEFT JOIN c ON c.segment_key = k.segment_key AND c.time_key = k.time_key""",
    "clean_log": f"""WITH {_WEATHER}, d AS (SELECT * FROM wr QUALIFY row_number() OVER (PARTITION BY reading_id ORDER BY received_at NULLS FIRST, timestamp NULLS FIRST, segment_id NULLS FIRST, {', '.join(f'{c} NULLS FIRST' for c in RANGES)}) = 1),
v AS (SELECT reading_id, segment_id, isodow(timestamp) AS dow, hour(timestamp) AS h, label, {', '.join(f'{e} AS {c}' for c, e in _V.items())} FROM d),
m AS (SELECT segment_id, dow, h, median(congestion_index) AS med FROM v GROUP BY ALL),
f AS (SELECT v.segment_id, coalesce(congestion_index, med) AS x FROM v JOIN m ON v.segment_id IS NOT DISTINCT FROM m.segment_id AND v.dow IS NOT DISTINCT FROM m.dow AND v.h IS NOT DISTINCT FROM m.h),
g AS (SELECT segment_id, coalesce(x, (SELECT median(x) FROM f)) AS x FROM f), s AS (SELECT segment_id, avg(x) AS a, stddev_pop(x) AS sd FROM g GROUP BY ALL)
SELECT (SELECT count(*) FROM readings) AS rows_in, (SELECT count(*) FROM readings) - (SELECT count(*) FROM d) AS duplicates,
  (SELECT {' + '.join(f'count(*) FILTER (NOT isnan({c}) AND NOT {c} BETWEEN {lo:g} AND {hi:g})' for c, (lo, hi) in RANGES.items())} FROM d) AS voided,
  (SELECT count(*) FROM v WHERE label IS NULL) AS weather_missing, (SELECT {' + '.join(f'count(*) - count({c})' for c in RANGES)} FROM v) AS imputed,
  (SELECT count(*) FROM g JOIN s USING (segment_id) WHERE abs(x - a) / coalesce(nullif(sd, 0), 1) > 4) AS outliers, (SELECT count(*) FROM d) AS rows_out""",
    "fk_check": " UNION ALL ".join([_orphan("traffic.segment", "fact_traffic", "segment_key", "dim_segment"), _orphan("traffic.time", "fact_traffic", "time_key", "dim_time"), _orphan("traffic.weather", "fact_traffic", "weather_key", "dim_weather"), _orphan("incident.segment", "fact_incident", "segment_key", "dim_segment")]),
    "seasonal_flags": f"""WITH {T_SQL}, r AS (SELECT zone, segment_key, day_name, hour, congestion_index AS x FROM t JOIN dim_segment USING (segment_key) JOIN dim_time USING (time_key) WHERE congestion_index IS NOT NULL),
g AS (SELECT segment_key, day_name, hour, avg(x) AS m, stddev_samp(x) AS sd FROM r GROUP BY ALL),
z AS (SELECT zone, coalesce((x - m) / nullif(sd, 0), 0) AS z FROM r JOIN g USING (segment_key, day_name, hour))
SELECT zone, count(*) AS n, CAST(sum(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, CAST(sum(CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS pct_flagged FROM z GROUP BY ALL""",
}
__all__ = ["QUERIES", "SQL", "davg"]
