"""Queries p1, p2, p3 and p5 over the road-traffic tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact
from strandcube.functions.labels import vocabulary
from strandcube.functions.values import present, ratio
from strandcube.operators.impute import Category, fill_missing, filled_cells
from strandcube.operators.effects import Field
from strandcube.operators.plausible import flag_implausible
from strandcube.operators.references import Reference, orphan_report, orphan_rows, sound_facts
from strandcube.operators.trailing import daily_sums, fill_days, latest_load, trailing_totals
from strandcube.session import cut
from strandcube.sources.tables import table

# The possible ranges of the measurements, and the offsets of their log scales.
SPEED = Field("avg_speed_kmph", 0.0, 160.0, 1.0)
OCCUPANCY = Field("occupancy_pct", 0.0, 100.0, 1.0)
COUNT = Field("vehicle_count", 0.0, 20_000.0, 1.0)
CONGESTION = Field("congestion_index", 0.0, 1.0, 0.01)


def _calm() -> F.Column:
    return F.coalesce(F.col("incident_active"), F.lit(0)) != 1


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings with weather, speed, count and occupancy filled, and 0/1 marks."""
    labels = tuple(vocabulary(table(spark, sf_dir, "dim_weather"), "weather"))
    cols = ["reading_id", "segment_id", "timestamp", "vehicle_count", "avg_speed_kmph", "occupancy_pct", "weather", "incident_active"]
    readings = table(spark, sf_dir, "readings").select(*cols)
    return fill_missing(readings, "segment_id", "timestamp", [SPEED, COUNT, OCCUPANCY], Category("weather", labels), _calm()).drop("incident_active")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(p1_filled(spark, sf_dir), "reading_id", ["weather", "avg_speed_kmph", "vehicle_count", "occupancy_pct"])


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: rows, filled values, values still missing, and filled ones out of the possible range or vocabulary."""
    filled = p1_filled(spark, sf_dir)
    labels = vocabulary(table(spark, sf_dir, "dim_weather"), "weather")
    cells = [F.struct(F.lit(f.name).alias("field_name"), F.col(f"{f.name}_filled").alias("mark"), F.col(f.name).isNull().alias("gap"), (~F.col(f.name).between(f.lo, f.hi)).alias("wild")) for f in (SPEED, COUNT, OCCUPANCY)]
    cells.append(F.struct(F.lit("weather").alias("field_name"), F.col("weather_filled").alias("mark"), F.col("weather").isNull().alias("gap"), (~F.col("weather").isin(labels)).alias("wild")))
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    rows = filled.select(F.inline(F.array(*cells)))
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_rows"), total(F.col("mark")).alias("n_filled"), total(F.col("gap")).alias("n_missing"), total((F.col("mark") == 1) & F.col("wild")).alias("n_wild"))


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible values with the kind of fault and its probability."""
    readings = table(spark, sf_dir, "readings")
    return flag_implausible(readings, "segment_id", "timestamp", "reading_id", [SPEED, OCCUPANCY, COUNT, CONGESTION], _calm())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_flags(spark, sf_dir).select("reading_id", "field_name")


def p2_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that follow from the values alone: out of range, or member of a run of at least 6 equal readings."""
    return p2_flags(spark, sf_dir).where(F.col("kind").isin("out_of_range", "stuck")).select("reading_id", "field_name", "kind")


def references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    traffic, incident = table(spark, sf_dir, "fact_traffic"), table(spark, sf_dir, "fact_incident")
    return [
        Reference("fact_traffic", traffic, "traffic_key", "segment_key", table(spark, sf_dir, "dim_segment"), "segment_key", parent_to="deleted_at"),
        Reference("fact_traffic", traffic, "traffic_key", "time_key", table(spark, sf_dir, "dim_time"), "time_key"),
        Reference("fact_incident", incident, "incident_key", "incident_type_key", table(spark, sf_dir, "dim_incident_type"), "incident_type_key", parent_to="deleted_at"),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_rows(references(spark, sf_dir)).select("fact_table", "key_column", "fact_key")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(references(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment and day of sound facts: each hour counts once, as it was loaded last."""
    sound = sound_facts(table(spark, sf_dir, "fact_traffic"), references(spark, sf_dir)[:2])
    sound = sound.select("segment_key", "time_key", "loaded_at", "traffic_key", "incident_count", present(F.col("congestion_index")).alias("congestion_index"))
    hours = latest_load(sound, ["segment_key", "time_key"], ["loaded_at", "traffic_key"], ["incident_count", "congestion_index"])
    hours = hours.select("segment_key", F.expr("try_to_date(cast(time_key div 100 as string), 'yyyyMMdd')").alias("day"), "incident_count", exact(F.col("congestion_index"), 18).alias("congestion"))
    daily = daily_sums(hours, "segment_key", "day", {"incidents": "incident_count", "congestion_total": "congestion"}, ["congestion"], "n_rows")
    return daily.withColumn("congestion_total", exact(F.col("congestion_total"), 24))


def _day_key(c: str) -> F.Column:
    return F.date_format(c, "yyyyMMdd").cast("bigint").alias("day_key")


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of incidents and totals and averages of congestion over the last 7 and 30 days, idle days included."""
    t = trailing_totals(_daily(spark, sf_dir), "segment_key", "day", ["incidents", "congestion_total", "n_congestion"], (7, 30))
    out = [F.col("segment_key"), _day_key("day"), F.col("is_idle")]
    for w in (7, 30):
        total = F.col(f"congestion_total_{w}d").cast("double")
        out += [F.col(f"incidents_{w}d").cast("bigint").alias(f"incidents_{w}d"), total.alias(f"congestion_total_{w}d"), ratio(total, F.col(f"n_congestion_{w}d")).alias(f"congestion_mean_{w}d")]
    return t.select(*out)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The idle days of :func:`p5_trailing`, which is made whole and stored first."""
    return cut(p5_trailing(spark, sf_dir)).where("is_idle = 1").select("segment_key", "day_key")


QUERIES = {"p1_filled": p1_filled, "p1_found": p1_found, "p1_limits": p1_limits, "p2_flags": p2_flags, "p2_found": p2_found, "p2_certain": p2_certain, "p3_found": p3_found, "p3_report": p3_report, "p5_trailing": p5_trailing, "p5_found": p5_found}

_P3 = """
SELECT '{fact}' AS fact_table, '{key}' AS key_column, CAST(f.{id} AS BIGINT) AS fact_key, f.loaded_at AS loaded
FROM {fact} f WHERE f.{key} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {dim} d WHERE d.{key} = f.{key} AND d.loaded_at <= f.loaded_at {deleted})"""
_GONE = "AND (d.deleted_at IS NULL OR d.deleted_at > f.loaded_at)"
_CASES = " UNION ALL ".join([
    _P3.format(fact="fact_traffic", key="segment_key", id="traffic_key", dim="dim_segment", deleted=_GONE),
    _P3.format(fact="fact_traffic", key="time_key", id="traffic_key", dim="dim_time", deleted=""),
    _P3.format(fact="fact_incident", key="incident_type_key", id="incident_key", dim="dim_incident_type", deleted=_GONE),
])
_SOUND = f"""
cases AS ({_CASES}),
sound AS (
  SELECT segment_key, CAST(strptime(CAST(time_key // 100 AS VARCHAR), '%Y%m%d') AS DATE) AS day, time_key, loaded_at, traffic_key,
         incident_count, CASE WHEN NOT isnan(congestion_index) THEN congestion_index END AS congestion_index
  FROM fact_traffic WHERE segment_key IS NOT NULL AND time_key IS NOT NULL
    AND traffic_key NOT IN (SELECT fact_key FROM cases WHERE fact_table = 'fact_traffic')),
days AS (
  SELECT segment_key, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT segment_key, min(day) AS a, max(day) AS b FROM sound GROUP BY ALL))"""

_P2 = """
SELECT reading_id, '{f}' AS field_name, min(kind) AS kind FROM (
  SELECT reading_id, 'out_of_range' AS kind FROM readings WHERE NOT isnan({f}) AND NOT {f} BETWEEN {lo:g} AND {hi:g}
  UNION ALL
  SELECT r.reading_id, 'stuck' FROM (
    SELECT segment_id, timestamp FROM (
      SELECT *, count(*) OVER (PARTITION BY segment_id, run) AS n FROM (
        SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY timestamp) AS run FROM (
          SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY segment_id ORDER BY timestamp) THEN 0 ELSE 1 END AS new FROM (
            SELECT segment_id, timestamp, min({f}) AS v FROM readings
            WHERE {f} IS NOT NULL AND NOT isnan({f}) AND segment_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY ALL)))) WHERE n >= 6) x
  JOIN readings r USING (segment_id, timestamp) WHERE r.{f} IS NOT NULL AND NOT isnan(r.{f})) GROUP BY reading_id"""

SQL = {
    "p2_certain": " UNION ALL ".join(_P2.format(f=x.name, lo=x.lo, hi=x.hi) for x in (SPEED, OCCUPANCY, COUNT, CONGESTION)),
    "p1_limits": " UNION ALL ".join(
        [f"SELECT '{x.name}' AS field_name, count(*) AS n_rows, count(*) FILTER ({x.name} IS NULL OR isnan({x.name})) AS n_filled, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_wild FROM readings" for x in (SPEED, COUNT, OCCUPANCY)]
        + ["""SELECT 'weather', count(*), count(*) FILTER (weather IS NULL OR lower(regexp_replace(weather, '[^A-Za-z]', '', 'g')) IN ('', 'na', 'nan', 'null', 'none', 'unknown', 'notreported', 'tbc')), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM readings"""]
    ),
    "p1_found": """
SELECT DISTINCT reading_id, field_name FROM (
  SELECT reading_id, 'avg_speed_kmph' AS field_name FROM readings WHERE avg_speed_kmph IS NULL OR isnan(avg_speed_kmph)
  UNION ALL SELECT reading_id, 'vehicle_count' FROM readings WHERE vehicle_count IS NULL OR isnan(vehicle_count)
  UNION ALL SELECT reading_id, 'occupancy_pct' FROM readings WHERE occupancy_pct IS NULL OR isnan(occupancy_pct)
  UNION ALL SELECT reading_id, 'weather' FROM readings
    WHERE weather IS NULL OR lower(regexp_replace(weather, '[^A-Za-z]', '', 'g'))
      IN ('', 'na', 'nan', 'null', 'none', 'unknown', 'notreported', 'tbc'))""",
    "p3_found": f"SELECT fact_table, key_column, fact_key FROM ({_CASES})",
    "p3_report": f"""
WITH cases AS ({_CASES}), refs AS (
  SELECT 'fact_traffic' AS fact_table, 'segment_key' AS key_column, loaded_at AS loaded FROM fact_traffic WHERE segment_key IS NOT NULL
  UNION ALL SELECT 'fact_traffic', 'time_key', loaded_at FROM fact_traffic WHERE time_key IS NOT NULL
  UNION ALL SELECT 'fact_incident', 'incident_type_key', loaded_at FROM fact_incident WHERE incident_type_key IS NOT NULL),
t AS (SELECT fact_table, key_column, strftime(loaded, '%Y-%m') AS month, count(*) AS n_references FROM refs GROUP BY ALL),
b AS (SELECT fact_table, key_column, strftime(loaded, '%Y-%m') AS month, count(*) AS n_orphans FROM cases GROUP BY ALL)
SELECT t.fact_table, t.key_column, t.month, t.n_references, coalesce(b.n_orphans, 0) AS n_orphans
FROM t LEFT JOIN b ON t.fact_table = b.fact_table AND t.key_column = b.key_column AND t.month IS NOT DISTINCT FROM b.month""",
    "p5_found": f"""
WITH {_SOUND}
SELECT segment_key, CAST(strftime(day, '%Y%m%d') AS BIGINT) AS day_key FROM days
WHERE (segment_key, day) NOT IN (SELECT (segment_key, day) FROM sound)""",
    "p5_trailing": f"""
WITH {_SOUND},
hours AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY segment_key, time_key ORDER BY loaded_at DESC, traffic_key DESC) = 1),
daily AS (
  SELECT segment_key, day, coalesce(sum(incident_count), 0) AS incidents, count(congestion_index) AS n,
         coalesce(sum(CAST(congestion_index AS DECIMAL(18,9))), 0) AS units FROM hours GROUP BY ALL),
full_days AS (
  SELECT days.segment_key, days.day, CAST(daily.day IS NULL AS INT) AS is_idle,
         coalesce(incidents, 0) AS i, coalesce(n, 0) AS n, coalesce(units, 0) AS u FROM days LEFT JOIN daily USING (segment_key, day))
SELECT segment_key, CAST(strftime(day, '%Y%m%d') AS BIGINT) AS day_key, is_idle,
  CAST(sum(i) OVER w7 AS BIGINT) AS incidents_7d, CAST(sum(u) OVER w7 AS DOUBLE) AS congestion_total_7d,
  CAST(sum(u) OVER w7 AS DOUBLE) / nullif(CAST(sum(n) OVER w7 AS BIGINT), 0) AS congestion_mean_7d,
  CAST(sum(i) OVER w30 AS BIGINT) AS incidents_30d, CAST(sum(u) OVER w30 AS DOUBLE) AS congestion_total_30d,
  CAST(sum(u) OVER w30 AS DOUBLE) / nullif(CAST(sum(n) OVER w30 AS BIGINT), 0) AS congestion_mean_30d
FROM full_days
WINDOW w7 AS (PARTITION BY segment_key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY segment_key ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
}
