"""Command line: run pipeline stages over generated feeds, or catalogue queries over a data folder."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandcube.functions.calendar import add_time_features, congestion_level, is_congested
from strandcube.operators.clean import clean_readings, dedup_keep_first, fill_group_median
from strandcube.operators.warehouse import ADVERSE, category, dim_date, dim_labels, dim_time, fact_incident, fact_traffic, incidents_per_hour, surrogate
from strandcube.queries import mining as mining_queries
from strandcube.queries import olap as olap_queries
from strandcube.queries.common import traffic_cube
from strandcube.sources import generator
from strandcube.sources.io import Config, load_config, manifest, read_json, require, write_csv, write_json, write_table

STAGES = ("generate", "preprocess", "etl", "olap", "mine", "visualize", "report", "export")
RANGES = {"avg_speed_kmph": (0.0, 160.0), "occupancy_pct": (0.0, 100.0), "vehicle_count": (0.0, 20_000.0), "congestion_index": (0.0, 1.0)}
#: The OLAP results that are written, by the query that makes them.
OLAP = {
    "roll_up_zone_month": "rollup_zone_month", "roll_up_city_quarter": "rollup_city_quarter", "drill_down_central": "drilldown_zone", "slice_heavy_rain": "slice_weather", "dice_subcube": "dice_subcube",
    "pivot_roadtype_hour": "pivot_roadtype_hour", "pivot_severity_weather": "pivot_severity_weather", "cube_incidents": "cube_incidents", "top_congested_segments": "top_congested_segments", "incident_impact": "incident_impact",
}
#: The mining results that are written, and the tables that figures are drawn from.
MINING = ("severity_models", "severity_importances", "severity_rules", "cluster_names", "kmeans_profiles", "hotspot_segments", "itemset_sizes", "top_itemsets", "association_rules", "rule_explorer", "forecast_models", "isolation_flags", "lowest_scores", "flagged_rows")
FIGURES = ("hour_profile", "day_hour_grid", "weather_impact", "incidents_by_type_hour", "overview_shares", "pca_profiles")


def generate(spark: SparkSession, cfg: Config) -> None:
    segs = generator.segments(spark, cfg.n_segments, cfg.seed)
    write_table(segs, f"{cfg.data_dir}/segments")
    write_table(generator.spoil(generator.readings(spark, segs, cfg.n_days, cfg.seed), cfg.seed), f"{cfg.data_dir}/readings")
    write_table(generator.spoil_incidents(generator.incidents(spark, segs, cfg.n_days, cfg.seed), cfg.seed), f"{cfg.data_dir}/incidents")


def preprocess(spark: SparkSession, cfg: Config) -> None:
    raw, inc, segs = (spark.read.parquet(require(f"{cfg.data_dir}/{n}")) for n in ("readings", "incidents", "segments"))
    clean, log = clean_readings(raw, RANGES, list(generator.WEATHER), cfg.outlier_z)
    inc = fill_group_median(dedup_keep_first(inc, ["incident_id"], ["timestamp", "segment_id"]), ["duration_min", "response_time_min"], ["incident_type", "severity"])
    rows = add_time_features(clean, "timestamp").withColumn("hour_ts", F.date_trunc("hour", "timestamp"))
    rows = rows.join(F.broadcast(segs.drop("segment_name")) if segs.limit(100_001).count() <= 100_000 else segs.drop("segment_name"), "segment_id", "left")
    rows = rows.join(incidents_per_hour(inc, "segment_id", "timestamp"), ["segment_id", "hour_ts"], "left").drop("hour_ts")
    rows = rows.withColumns({"congestion_level": congestion_level(F.col("congestion_index")), "is_congested": is_congested(F.col("congestion_index"))})
    write_table(rows, f"{cfg.out_dir}/base", ["year", "month"])
    write_table(inc, f"{cfg.out_dir}/incident_log")
    write_json(log.first().asDict(), f"{cfg.out_dir}/preprocessing_report.json")


def etl(spark: SparkSession, cfg: Config) -> None:
    base, inc = spark.read.parquet(require(f"{cfg.out_dir}/base")), spark.read.parquet(require(f"{cfg.out_dir}/incident_log"))
    seg = surrogate(spark.read.parquet(f"{cfg.data_dir}/segments"), ["segment_id"], "segment_key")
    wea = dim_labels(base.select("weather"), "weather", "weather_key", {"is_adverse": F.col("weather").isin(*ADVERSE).cast("int")})
    typ = dim_labels(inc.select("incident_type"), "incident_type", "incident_type_key", {"category": category(F.col("incident_type"))})
    times = dim_time(base.select("timestamp"), inc.select("timestamp"))
    for name, df in (("dim_segment", seg), ("dim_weather", wea), ("dim_incident_type", typ), ("dim_time", times), ("dim_date", dim_date(times.select("date")))):
        write_table(df, f"{cfg.out_dir}/{name}.parquet")
    seg, wea, typ = (spark.read.parquet(f"{cfg.out_dir}/{n}.parquet") for n in ("dim_segment", "dim_weather", "dim_incident_type"))
    write_table(fact_traffic(base, seg, wea), f"{cfg.out_dir}/fact_traffic.parquet")
    traffic = spark.read.parquet(f"{cfg.out_dir}/fact_traffic.parquet")
    write_table(fact_incident(inc, traffic, seg, wea, typ), f"{cfg.out_dir}/fact_incident.parquet")
    cube = traffic_cube(spark, cfg.out_dir)
    for name, levels in (("agg_zone_month", ["zone", "year", "quarter", "month"]), ("agg_roadtype_hour", ["road_type", "hour", "is_weekend"]), ("agg_segment_daily", ["segment_id", "date"])):
        cube.materialise(levels, path=f"{cfg.out_dir}/{name}.parquet")


def _write_queries(spark: SparkSession, cfg: Config, folder: str, names: dict[str, str]) -> None:
    require(f"{cfg.out_dir}/fact_traffic.parquet")
    for file, query in names.items():
        write_csv((olap_queries.QUERIES | mining_queries.QUERIES)[query](spark, cfg.out_dir), f"{cfg.out_dir}/{folder}/{file}")


def olap(spark: SparkSession, cfg: Config) -> None:
    _write_queries(spark, cfg, "olap", OLAP)


def mine(spark: SparkSession, cfg: Config) -> None:
    _write_queries(spark, cfg, "mining", {n: n for n in MINING})


def visualize(spark: SparkSession, cfg: Config) -> None:
    """The tables that figures are drawn from; nothing is drawn."""
    _write_queries(spark, cfg, "figures", {n: n for n in FIGURES})


def _tables(cfg: Config) -> dict[str, str]:
    return {p.name.removesuffix(".parquet"): str(p) for p in sorted(Path(cfg.out_dir).glob("*.parquet"))}


def report(spark: SparkSession, cfg: Config) -> None:
    """findings.md: rows of the tables, the cleaning log, and the first lines of each result."""
    lines = ["# Findings", "", "## Tables", "", "| table | rows |", "|-|-|"]
    lines += [f"| {n} | {spark.read.parquet(p).count()} |" for n, p in _tables(cfg).items()]
    log = read_json(f"{cfg.out_dir}/preprocessing_report.json")
    lines += ["", "## Cleaning", "", "| step | rows |", "|-|-|", *[f"| {k} | {v} |" for k, v in log.items()]]
    for folder in ("olap", "mining"):
        for p in sorted(Path(cfg.out_dir, folder).glob("*")):
            head = spark.read.option("header", True).csv(str(p)).limit(12)
            lines += ["", f"## {p.name}", "", f"| {' | '.join(head.columns)} |", "|" + "-|" * len(head.columns)]
            lines += [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in head.collect()]
    Path(cfg.out_dir, "findings.md").write_text("\n".join(lines) + "\n")


def export(spark: SparkSession, cfg: Config) -> None:
    counts = {n: spark.read.parquet(p).count() for n, p in _tables(cfg).items() if n != "manifest"}
    write_table(manifest(spark, counts, time.strftime("%Y-%m-%dT%H:%M:%S")), f"{cfg.out_dir}/manifest.parquet")
    write_json({"tables": counts}, f"{cfg.out_dir}/report.json")


def main(argv: Sequence[str] | None = None) -> int:
    from strandcube.session import build_session

    p = argparse.ArgumentParser(prog="strandcube", description=__doc__)
    p.add_argument("--config", help="JSON or YAML file of parameters")
    p.add_argument("--stages", nargs="*", default=list(STAGES), choices=STAGES)
    p.add_argument("--skip-generate", action="store_true", help="use the feeds that are there")
    args = p.parse_args(argv)
    cfg = load_config(args.config) if args.config else Config()
    spark = build_session()
    for s in args.stages:
        if s == "generate" and args.skip_generate:
            continue
        began = time.time()
        globals()[s](spark, cfg)
        print(f"{s}: {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
