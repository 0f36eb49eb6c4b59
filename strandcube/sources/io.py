"""Readers and writers at the edges: CSV, JSON, Parquet tables, manifest, configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("reading_id", T.StringType()), T.StructField("segment_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("vehicle_count", T.DoubleType()),
    T.StructField("avg_speed_kmph", T.DoubleType()), T.StructField("occupancy_pct", T.DoubleType()), T.StructField("travel_time_min", T.DoubleType()), T.StructField("congestion_index", T.DoubleType()),
    T.StructField("weather", T.StringType()), T.StructField("temperature_c", T.DoubleType()), T.StructField("precipitation_mm", T.DoubleType()), T.StructField("incident_active", T.IntegerType()),
])
INCIDENTS = T.StructType([
    T.StructField("incident_id", T.StringType()), T.StructField("segment_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("incident_type", T.StringType()),
    T.StructField("severity", T.IntegerType()), T.StructField("vehicles_involved", T.IntegerType()), T.StructField("lanes_blocked", T.IntegerType()), T.StructField("duration_min", T.DoubleType()),
    T.StructField("response_time_min", T.DoubleType()), T.StructField("weather", T.StringType()), T.StructField("casualties", T.IntegerType()),
])
SEGMENTS = T.StructType([
    T.StructField("segment_id", T.StringType()), T.StructField("segment_name", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("road_type", T.StringType()), T.StructField("lanes", T.IntegerType()),
    T.StructField("length_km", T.DoubleType()), T.StructField("speed_limit_kmph", T.IntegerType()), T.StructField("signalised", T.IntegerType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
])
BOM = b"\xef\xbb\xbf"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header under a fixed schema; unreadable values become NULL, nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bom_csv(df: DataFrame, path: str, max_rows: int = 1_000_000) -> int:
    """One CSV file with a byte-order mark for spreadsheet tools; refuses more than ``max_rows`` rows. Returns the rows."""
    rows = df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write partitioned CSV instead")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(BOM + rows.to_csv(index=False).encode())
    return len(rows)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL (``:name`` markers)."""
    return spark.sql(sql, args=params)


def dump_tables(spark: SparkSession, names: Sequence[str], out_dir: str) -> dict[str, int]:
    """Catalogue tables to Parquet, skipping those that do not exist; returns row counts."""
    done = {}
    for n in names:
        if spark.catalog.tableExists(n):
            write_table(spark.table(n), os.path.join(out_dir, n))
            done[n] = spark.table(n).count()
    return done


def manifest(spark: SparkSession, counts: Mapping[str, int], exported_at: str) -> DataFrame:
    """``table, row_count, exported_at`` in the order of names."""
    rows = [(k, int(v), exported_at) for k, v in sorted(counts.items())]
    return spark.createDataFrame(rows, "table string, row_count bigint, exported_at string")


def write_json(payload: Mapping, path: str) -> None:
    """A result dictionary without its private (underscored) keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({k: v for k, v in payload.items() if not str(k).startswith("_")}, indent=2, default=str))


def read_json(path: str) -> dict:
    """The dictionary of a JSON file, empty if there is none."""
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def require(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} does not exist; run the stage that writes it first")
    return path


@dataclass
class Config:
    """Pipeline parameters; every field can be overridden from a JSON or YAML file."""

    data_dir: str = "data"
    out_dir: str = "out"
    seed: int = 42
    n_segments: int = 60
    n_days: int = 365
    outlier_z: float = 4.0
    bins: list = field(default_factory=lambda: [0.0, 0.35, 0.60, 0.80, 1.01])
    min_support: float = 0.05
    min_confidence: float = 0.55
    min_lift: float = 1.1
    k_range: list = field(default_factory=lambda: [2, 8])
    horizon: int = 168


def load_config(path: str) -> Config:
    """Unknown keys are refused; relative folders are resolved against the file and made."""
    text = Path(require(path)).read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    unknown = set(raw) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(sorted(unknown))}")
    cfg = Config(**raw)
    base = Path(path).resolve().parent
    cfg.data_dir, cfg.out_dir = str(base / cfg.data_dir), str(base / cfg.out_dir)
    Path(cfg.out_dir).mkdir(parents=True, exist_ok=True)
    return cfg
