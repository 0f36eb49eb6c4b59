"""OLAP and measure-layer queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact_avg
from strandcube.functions.values import ratio
from strandcube.plans.measures import DERIVED, INCIDENTS, TIMED, TRAFFIC, MeasureModel
from strandcube.queries.common import INCIDENT_AGGS, SEG, T_SQL, TIME, TRAFFIC_AGGS, TYPE, WEATHER, davg, incident_cube, traffic_cube

HOURS = tuple(range(24))
ROAD_TYPES = ("Arterial", "Collector", "Highway", "Residential")
WEATHERS = ("Clear", "Cloudy", "Fog", "Heavy Rain", "Rain", "Sleet")


def rollup_zone_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored cuboid of zones, quarters and months."""
    cube = traffic_cube(spark, sf_dir)
    cube.materialise(["zone", "year", "quarter", "month"])
    return cube.roll_up(["zone", "year", "month"])


def rollup_city_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).roll_up(["year", "quarter"])


def drilldown_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).drill_down("zone", "Central", ["segment_id", "hour"], ["n_obs", "avg_congestion", "avg_speed"])


def slice_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).slice("weather", "Heavy Rain", ["road_type"], ["n_obs", "avg_congestion", "pct_congested"])


def dice_subcube(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"zone": ["Central", "North"], "road_type": ["Highway", "Arterial"], "hour": ("between", 7, 10)}
    return traffic_cube(spark, sf_dir).dice(where, ["zone", "road_type", "day_name"], ["n_obs", "avg_congestion", "avg_speed"])


def pivot_roadtype_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the weekday and weekend means, both weighted alike, per road type and hour."""
    cube = traffic_cube(spark, sf_dir)
    cube.materialise(["road_type", "hour", "is_weekend"], ["n_obs", "avg_congestion"])
    cuboid = cube.roll_up(["road_type", "hour", "is_weekend"], ["avg_congestion"])
    named = cuboid.withColumn("_h", F.format_string("h%02d", "hour"))
    return named.groupBy("road_type").pivot("_h", [f"h{h:02d}" for h in HOURS]).agg(F.round(F.avg("avg_congestion"), 6))


def pivot_severity_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incident_cube(spark, sf_dir).pivot(["severity"], "weather", WEATHERS, "n_incidents", fill=0)
    return out.select("severity", *[F.col(w).alias(w.lower().replace(" ", "_")) for w in WEATHERS])


def cube_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_cube(spark, sf_dir).cube(["incident_type", "zone"])


def top_congested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).top(["segment_id"], "avg_congestion", 10, ["n_obs", "avg_congestion", "avg_speed"])


def incident_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("incident_count") > 0, "with incident").otherwise("without incident")
    return traffic_cube(spark, sf_dir).compare(bucket, "bucket")


def cuboid_zone_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).materialise(["zone", "year", "month"], ["n_obs", "avg_congestion", "vehicle_km_total"])


def cuboid_roadtype_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).materialise(["road_type", "hour", "is_weekend"], ["n_obs", "avg_congestion", "avg_speed"])


def cuboid_segment_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traffic_cube(spark, sf_dir).materialise(["segment_id", "date"], ["n_obs", "avg_congestion", "incident_total"])
    return out.withColumn("date", F.col("date").cast("string"))


def _model(spark: SparkSession, sf_dir: str) -> MeasureModel:
    t = traffic_cube(spark, sf_dir).star(["zone", "year", "month", "date", "hour", "is_peak_hour", "is_adverse"])
    i = incident_cube(spark, sf_dir).star(["zone", "year", "month", "date", "hour", "is_adverse"])
    return MeasureModel({"traffic": t, "incident": i}, TRAFFIC + INCIDENTS, DERIVED, TIMED)


_BASIC = ["observations", "avg_congestion", "peak_congestion", "avg_speed", "avg_speed_ratio", "avg_travel_time", "avg_delay_index", "vehicle_km_total", "congested_hours", "congested_hours_pct",
          "incidents", "major_incidents", "major_incident_pct", "avg_severity", "avg_response_time", "avg_incident_duration", "casualties_total", "incidents_per_1k_hours"]


def measures_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of both facts per zone and month."""
    return _model(spark, sf_dir).query(_BASIC, ["zone", "month"])


def measures_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts that set their own weather and rush-hour filters, under a filter on hours."""
    names = ["avg_congestion_adverse", "wet_weather_penalty", "peak_offpeak_ratio", "avg_congestion"]
    return _model(spark, sf_dir).query(names, ["zone"], {"is_adverse": [0], "hour": list(range(6, 22))})


def measures_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the month before and the change since, per month."""
    names = ["avg_congestion", "avg_congestion_pm", "avg_congestion_mom", "incidents", "incidents_pm", "incidents_mom"]
    return _model(spark, sf_dir).query(names, ["year", "month"])


def measures_rolling7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the daily means of the last seven days, per zone and day."""
    out = _model(spark, sf_dir).query(["avg_congestion", "avg_congestion_7d"], ["zone", "date"])
    return out.select("zone", F.col("date").cast("string").alias("date"), "avg_congestion", F.round("avg_congestion_7d", 8).alias("avg_congestion_7d"))


def measures_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time measures per zone and month under filters on weather, hours and the month."""
    names = ["avg_congestion", "avg_congestion_pm", "avg_congestion_mom", "avg_congestion_7d"]
    out = _model(spark, sf_dir).query(names, ["zone", "month"], {"is_adverse": [0], "hour": list(range(6, 22)), "month": [4, 5]})
    return out.select("zone", "month", *[F.round(c, 8).alias(c) for c in names])


def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday and weekend profile of the day."""
    rows = traffic_cube(spark, sf_dir).star(["hour", "is_weekend"])
    flag = lambda v: exact_avg(F.when(F.col("is_weekend") == v, F.col("congestion_index")))
    return rows.groupBy("hour").agg(flag(0).alias("weekday"), flag(1).alias("weekend"))


def day_hour_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).roll_up(["day_name", "hour"], ["avg_congestion"])


def weather_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_cube(spark, sf_dir).roll_up(["weather", "is_adverse"], ["n_obs", "avg_congestion", "avg_speed"])


def incidents_by_type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_cube(spark, sf_dir).roll_up(["category", "incident_type", "hour"], ["n_incidents", "avg_duration"])


def overview_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity share within each road type."""
    rows = incident_cube(spark, sf_dir).star(["road_type"]).where("severity IS NOT NULL")
    counts = rows.groupBy("road_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("road_type").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(totals), "road_type").select("road_type", "severity", "n", ratio(F.col("n").cast("double"), F.col("total")).alias("share"))


QUERIES = {f.__name__: f for f in (
    rollup_zone_month, rollup_city_quarter, drilldown_zone, slice_weather, dice_subcube, pivot_roadtype_hour, pivot_severity_weather, cube_incidents, top_congested_segments, incident_impact,
    cuboid_zone_month, cuboid_roadtype_hour, cuboid_segment_day, measures_by_zone, measures_contrast, measures_mom, measures_rolling7d, measures_in_context,
    hour_profile, day_hour_grid, weather_impact, incidents_by_type_hour, overview_shares)}

_T = f"WITH {T_SQL} SELECT"
_AVG, _SPEED = f"{davg('congestion_index')} AS avg_congestion", f"{davg('avg_speed_kmph')} AS avg_speed"
_HOURS = ", ".join(f"round(avg(CASE WHEN hour = {h} THEN a END), 6) AS h{h:02d}" for h in HOURS)
_W = ", ".join(f"count(*) FILTER (weather = '{w}') AS {w.lower().replace(' ', '_')}" for w in WEATHERS)
_FACTS = f"""{T_SQL},
tr AS (SELECT zone, month, count(*) AS observations, {_AVG}, max(congestion_index) AS peak_congestion, {_SPEED}, {davg('speed_ratio')} AS avg_speed_ratio,
  {davg('travel_time_min')} AS avg_travel_time, {davg('delay_index')} AS avg_delay_index, CAST(sum(CAST(vehicle_km AS DECIMAL(28,9))) AS DOUBLE) AS vehicle_km_total,
  count(*) FILTER (is_congested = 1) AS congested_hours FROM t {SEG} {TIME} {WEATHER} GROUP BY ALL),
inc AS (SELECT zone, month, count(*) AS incidents, count(*) FILTER (is_major = 1) AS major_incidents, {davg('severity')} AS avg_severity, {davg('response_time_min')} AS avg_response_time,
  {davg('duration_min')} AS avg_incident_duration, CAST(sum(casualties) AS BIGINT) AS casualties_total FROM fact_incident {SEG} {TIME} {WEATHER} GROUP BY ALL)"""

SQL = {
    "rollup_zone_month": f"{_T} zone, year, month, {TRAFFIC_AGGS} FROM t {SEG} {TIME} GROUP BY ALL",
    "rollup_city_quarter": f"{_T} year, quarter, {TRAFFIC_AGGS} FROM t {TIME} GROUP BY ALL",
    "drilldown_zone": f"{_T} segment_id, hour, count(*) AS n_obs, {_AVG}, {_SPEED} FROM t {SEG} {TIME} WHERE zone = 'Central' GROUP BY ALL",
    "slice_weather": f"{_T} road_type, count(*) AS n_obs, {_AVG}, CAST(sum(is_congested) AS DOUBLE) * 100 / nullif(count(is_congested), 0) AS pct_congested FROM t {SEG} {WEATHER} WHERE weather = 'Heavy Rain' GROUP BY ALL",
    "dice_subcube": f"{_T} zone, road_type, day_name, count(*) AS n_obs, {_AVG}, {_SPEED} FROM t {SEG} {TIME} WHERE zone IN ('Central', 'North') AND road_type IN ('Highway', 'Arterial') AND hour BETWEEN 7 AND 10 GROUP BY ALL",
    "pivot_roadtype_hour": f"WITH {T_SQL}, c AS (SELECT road_type, hour, is_weekend, {davg('congestion_index')} AS a FROM t {SEG} {TIME} GROUP BY ALL) SELECT road_type, {_HOURS} FROM c GROUP BY ALL",
    "pivot_severity_weather": f"SELECT severity, {_W} FROM fact_incident {WEATHER} GROUP BY ALL",
    "cube_incidents": f"SELECT CASE WHEN grouping(incident_type) = 1 THEN 'ALL' ELSE incident_type END AS incident_type, CASE WHEN grouping(zone) = 1 THEN 'ALL' ELSE zone END AS zone, {INCIDENT_AGGS} FROM fact_incident {SEG} {TYPE} GROUP BY CUBE (y.incident_type, s.zone)",
    "top_congested_segments": f"{_T} segment_id, count(*) AS n_obs, {_AVG}, {_SPEED} FROM t {SEG} GROUP BY ALL ORDER BY avg_congestion DESC NULLS LAST, segment_id LIMIT 10",
    "incident_impact": f"{_T} CASE WHEN incident_count > 0 THEN 'with incident' ELSE 'without incident' END AS bucket, {TRAFFIC_AGGS} FROM t GROUP BY ALL",
    "cuboid_zone_month": f"{_T} zone, year, month, count(*) AS n_obs, {_AVG}, CAST(sum(CAST(vehicle_km AS DECIMAL(28,9))) AS DOUBLE) AS vehicle_km_total FROM t {SEG} {TIME} GROUP BY ALL",
    "cuboid_roadtype_hour": f"{_T} road_type, hour, is_weekend, count(*) AS n_obs, {_AVG}, {_SPEED} FROM t {SEG} {TIME} GROUP BY ALL",
    "cuboid_segment_day": f"{_T} segment_id, CAST(date AS VARCHAR) AS date, count(*) AS n_obs, {_AVG}, CAST(sum(incident_count) AS BIGINT) AS incident_total FROM t {SEG} {TIME} GROUP BY ALL",
    "measures_by_zone": f"""WITH {_FACTS} SELECT zone, month, tr.* EXCLUDE (zone, month), CAST(congested_hours AS DOUBLE) / nullif(observations, 0) AS congested_hours_pct, inc.* EXCLUDE (zone, month),
  CAST(major_incidents AS DOUBLE) / nullif(incidents, 0) AS major_incident_pct, CAST(incidents AS DOUBLE) / nullif(observations, 0) * 1000 AS incidents_per_1k_hours FROM tr FULL JOIN inc USING (zone, month)""",
    "measures_contrast": f"""{_T} zone, {davg('CASE WHEN is_adverse = 1 THEN congestion_index END')} AS avg_congestion_adverse,
  {davg('CASE WHEN is_adverse = 1 THEN congestion_index END')} - {davg('CASE WHEN is_adverse = 0 THEN congestion_index END')} AS wet_weather_penalty,
  ({davg('CASE WHEN is_adverse = 0 AND is_peak_hour = 1 THEN congestion_index END')}) / nullif({davg('CASE WHEN is_adverse = 0 AND is_peak_hour = 0 THEN congestion_index END')}, 0) AS peak_offpeak_ratio,
  {davg('CASE WHEN is_adverse = 0 THEN congestion_index END')} AS avg_congestion FROM t {SEG} {TIME} {WEATHER} WHERE hour BETWEEN 6 AND 21 GROUP BY ALL""",
    "measures_mom": f"""WITH {T_SQL}, a AS (SELECT year, month, year * 12 + month AS k, {_AVG} FROM t {SEG} {TIME} {WEATHER} GROUP BY ALL),
b AS (SELECT year, month, count(*) AS incidents FROM fact_incident {SEG} {TIME} {WEATHER} GROUP BY ALL), m AS (SELECT * FROM a FULL JOIN b USING (year, month))
SELECT m.year, m.month, m.avg_congestion, p.avg_congestion AS avg_congestion_pm, (m.avg_congestion - p.avg_congestion) / nullif(p.avg_congestion, 0) AS avg_congestion_mom,
  m.incidents, p.incidents AS incidents_pm, CAST(m.incidents - p.incidents AS DOUBLE) / nullif(p.incidents, 0) AS incidents_mom FROM m LEFT JOIN m p ON m.k = p.k + 1""",
    "measures_rolling7d": f"""WITH {T_SQL}, a AS (SELECT zone, date, {_AVG} FROM t {SEG} {TIME} {WEATHER} GROUP BY ALL)
SELECT zone, CAST(date AS VARCHAR) AS date, avg_congestion, round(avg(avg_congestion) OVER (PARTITION BY zone ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 8) AS avg_congestion_7d FROM a""",
    "measures_in_context": f"""WITH {T_SQL}, r AS (SELECT zone, month, date, congestion_index FROM t {SEG} {TIME} {WEATHER} WHERE is_adverse = 0 AND hour BETWEEN 6 AND 21),
m AS (SELECT zone, month, {_AVG}, max(date) AS last FROM r GROUP BY ALL), d AS (SELECT zone, date, {_AVG} FROM r GROUP BY ALL)
SELECT m.zone, m.month, round(m.avg_congestion, 8) AS avg_congestion, round(p.avg_congestion, 8) AS avg_congestion_pm, round((m.avg_congestion - p.avg_congestion) / nullif(p.avg_congestion, 0), 8) AS avg_congestion_mom,
  (SELECT round(avg(d.avg_congestion), 8) FROM d WHERE d.zone IS NOT DISTINCT FROM m.zone AND d.date BETWEEN m.last - INTERVAL 6 DAY AND m.last) AS avg_congestion_7d
FROM m LEFT JOIN m p ON m.zone IS NOT DISTINCT FROM p.zone AND m.month = p.month + 1 WHERE m.month IN (4, 5)""",
    "hour_profile": f"{_T} hour, {davg('CASE WHEN is_weekend = 0 THEN congestion_index END')} AS weekday, {davg('CASE WHEN is_weekend = 1 THEN congestion_index END')} AS weekend FROM t {TIME} GROUP BY ALL",
    "day_hour_grid": f"{_T} day_name, hour, {_AVG} FROM t {TIME} GROUP BY ALL",
    "weather_impact": f"{_T} weather, is_adverse, count(*) AS n_obs, {_AVG}, {_SPEED} FROM t {WEATHER} GROUP BY ALL",
    "incidents_by_type_hour": f"SELECT category, incident_type, hour, count(*) AS n_incidents, {davg('duration_min')} AS avg_duration FROM fact_incident {TIME} {TYPE} GROUP BY ALL",
    "overview_shares": f"SELECT road_type, severity, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY road_type) AS BIGINT) AS share FROM (SELECT road_type, severity, count(*) AS n FROM fact_incident {SEG} WHERE severity IS NOT NULL GROUP BY ALL)",
}
