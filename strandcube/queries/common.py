"""Frames that several query groups share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcube.functions.values import present
from strandcube.plans.cube import Cube, Dimension, exact_total_of, mean_of, percent_of, rows_of, total_of
from strandcube.sources.tables import table


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_traffic with not-a-number as NULL."""
    return table(spark, sf_dir, "fact_traffic").withColumn("congestion_index", present(F.col("congestion_index")))


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, Dimension]:
    return {
        "segment": Dimension(table(spark, sf_dir, "dim_segment"), "segment_key", ("zone", "road_type", "segment_id", "segment_key")),
        "time": Dimension(table(spark, sf_dir, "dim_time"), "time_key", ("year", "quarter", "month", "date", "day_name", "hour", "is_weekend", "is_peak_hour", "time_of_day", "timestamp", "time_key")),
        "weather": Dimension(table(spark, sf_dir, "dim_weather"), "weather_key", ("weather", "is_adverse", "weather_key")),
        "type": Dimension(table(spark, sf_dir, "dim_incident_type"), "incident_type_key", ("category", "incident_type", "incident_type_key")),
    }


def traffic_cube(spark: SparkSession, sf_dir: str) -> Cube:
    measures = {
        "n_obs": rows_of(), "avg_congestion": mean_of("congestion_index"), "avg_speed": mean_of("avg_speed_kmph"),
        "vehicle_km_total": exact_total_of("vehicle_km"), "pct_congested": percent_of("is_congested"), "incident_total": total_of("incident_count"),
    }
    dims = {k: v for k, v in dimensions(spark, sf_dir).items() if k != "type"}
    return Cube(traffic(spark, sf_dir), dims, measures)


def incident_cube(spark: SparkSession, sf_dir: str) -> Cube:
    measures = {
        "n_incidents": rows_of(), "avg_severity": mean_of("severity"), "avg_duration": mean_of("duration_min"),
        "avg_response": mean_of("response_time_min"), "casualty_total": total_of("casualties"),
    }
    return Cube(table(spark, sf_dir, "fact_incident"), dimensions(spark, sf_dir), measures)


def davg(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE) / nullif(count({c}), 0)"


def dsum(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE)"


T_SQL = "t AS (SELECT * REPLACE (CASE WHEN NOT isnan(congestion_index) THEN congestion_index END AS congestion_index) FROM fact_traffic)"
SEG, TIME, WEATHER, TYPE = "JOIN dim_segment s USING (segment_key)", "JOIN dim_time d USING (time_key)", "JOIN dim_weather w USING (weather_key)", "JOIN dim_incident_type y USING (incident_type_key)"
TRAFFIC_AGGS = f"""count(*) AS n_obs, {davg('congestion_index')} AS avg_congestion, {davg('avg_speed_kmph')} AS avg_speed, {dsum('vehicle_km')} AS vehicle_km_total,
  CAST(sum(is_congested) AS DOUBLE) * 100 / nullif(count(is_congested), 0) AS pct_congested, CAST(sum(incident_count) AS BIGINT) AS incident_total"""
INCIDENT_AGGS = f"""count(*) AS n_incidents, {davg('severity')} AS avg_severity, {davg('duration_min')} AS avg_duration, {davg('response_time_min')} AS avg_response,
  CAST(sum(casualties) AS BIGINT) AS casualty_total"""
