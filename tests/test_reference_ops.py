"""Cleaning, features, warehouse, cube, measures and mining operators on hand-made frames."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandcube.functions.calendar import DURATION_BANDS, VEHICLE_BANDS, add_time_features, band, congestion_level, is_congested, time_key
from strandcube.operators import effects, plausible, references
from strandcube.operators.clean import dedup_keep_first, fill_group_median, fill_group_mode, flag_outliers, seasonal_z, void_ranges
from strandcube.operators.effects import Field
from strandcube.operators.mining.clusters import cluster_indices, dbscan, kmeans_best, pca_plane, silhouettes, standardise
from strandcube.operators.mining.evaluate import balanced_weights, confusion_matrix, regression_metrics, stratified_holdout, summary
from strandcube.operators.mining.isolation import IsolationForest
from strandcube.operators.mining.rules import frequent_itemsets, rules, tagged
from strandcube.operators.mining.series import supervised, tail_split
from strandcube.operators.warehouse import dim_date, dim_labels, dim_time, lookup_keys, orphan_counts, surrogate
from strandcube.plans.cube import Cube, Dimension, mean_of, percent_of, rows_of, total_of
from strandcube.plans.measures import DERIVED, INCIDENTS, MINING, TRAFFIC, TIMED, MeasureModel
from strandcube.sources import generator
from strandcube.sources.io import Config, dump_tables, load_config, manifest, read_csv, read_json, read_query, require, write_bom_csv, write_csv, write_json
from strandcube.sources.io import SEGMENTS
from strandcube.streaming.windows import hourly_counts, read_stream, run_available, sessions

START = datetime(2024, 1, 1)


def test_clean_order(spark):
    rows = [(f"r{i}", START + timedelta(hours=i), float(20 + i % 9), 50.0, "Clear") for i in range(48)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "id string, ts timestamp, speed double, occ double, weather string")
    once = dedup_keep_first(df, ["id"], ["ts"])
    assert df.count() - once.count() == 10
    bad = once.withColumn("speed", F.when(F.col("id") == "r5", -1.0).otherwise(F.col("speed"))).withColumn("occ", F.when(F.col("id") == "r6", 150.0).when(F.col("id") == "r7", float("nan")).otherwise(F.col("occ")))
    voided = void_ranges(bad, {"speed": (0, 160), "occ": (0, 100), "absent": (0, 1)})
    assert [r[0] for r in voided.select(F.count("speed")).collect()] == [47] and voided.where("occ IS NULL").count() == 2
    filled = fill_group_median(voided.withColumn("h", F.hour("ts")), ["speed", "occ"], ["h"])
    assert filled.where("speed IS NULL OR occ IS NULL").count() == 0 and filled.count() == 48


def test_fill_mode_ties_and_default(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "b"), ("a", None), ("b", None), (None, "q"), (None, None)], "g string, w string")
    got = sorted(((r.g or "-"), r.w) for r in fill_group_mode(df, "w", "g", "Clear").collect())
    assert got == [("-", "q"), ("-", "q"), ("a", "b"), ("a", "b"), ("a", "x"), ("b", "Clear")]


def test_outliers_and_seasonal_z(spark):
    df = spark.createDataFrame([("a", 1.0 + (i % 2) * 0.1) for i in range(60)] + [("a", 9.0), ("b", 5.0), ("c", None)], "g string, x double")
    got = {(r.g, r.x): r.is_outlier for r in flag_outliers(df, "x", ["g"]).collect()}
    assert got[("a", 9.0)] == 1 and got[("b", 5.0)] == 0 and got[("c", None)] == 0
    z = {(r.g, r.x): (r.seasonal_z, r.is_seasonal_anomaly) for r in seasonal_z(df, "x", ["g"]).collect()}
    assert z[("b", 5.0)] == (0.0, 0) and z[("a", 9.0)][1] == 1


def test_calendar_and_bands(spark):
    df = add_time_features(spark.createDataFrame([(datetime(2024, 1, 6, 7, 30),), (datetime(2024, 12, 30, 23, 0),)], "ts timestamp"), "ts").orderBy("ts")
    a, b = df.collect()
    assert (a.day_of_week, a.is_weekend, a.is_peak_hour, a.time_of_day, a.day_name) == (5, 1, 1, "Morning", "Saturday")
    assert (b.week_of_year, b.time_of_day) == (1, "Late Evening") and abs(a.hour_sin**2 + a.hour_cos**2 - 1) < 1e-9
    assert df.select(time_key(F.col("ts"))).first()[0] == 2024010607
    x = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.35, 0.5, 0.6, 0.7, 0.99, 1.02, None)], "c double").select(congestion_level(F.col("c")), is_congested(F.col("c"))).collect()
    assert [r[0] for r in x] == ["Free flow", "Free flow", "Free flow", "Light", "Light", "Moderate", "Severe", None, None]
    assert [r[1] for r in x] == [0, 0, 0, 0, 1, 1, 1, 1, None]
    y = spark.createDataFrame([(20.0, 0), (20.5, 3), (float("nan"), 4)], "d double, v int").select(band(F.col("d"), DURATION_BANDS, -1), band(F.col("v"), VEHICLE_BANDS, 0)).collect()
    assert [tuple(r) for r in y] == [("<=20min", None), ("20-45min", "2-3"), (None, "4+")]


def test_warehouse(spark):
    t = spark.createDataFrame([(START,), (START + timedelta(minutes=59),), (START + timedelta(days=3),), (None,)], "ts timestamp")
    assert dim_time(t, t).count() == 2
    d = dim_date(t).orderBy("date").collect()
    assert [r.date_key for r in d] == [20240101, 20240102, 20240103, 20240104] and d[0].day_of_week == 1
    dim = dim_labels(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "w string"), "w", "k")
    assert [tuple(r) for r in dim.orderBy("k").collect()] == [(1, "a"), (2, "b")]
    fact = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "w string, id int")
    keyed = lookup_keys(fact, [(dim, "w", "k")])
    assert {r.id: r.k for r in keyed.collect()} == {1: 1, 2: None, 3: None}
    assert orphan_counts([("x", spark.createDataFrame([(1,), (9,), (9,), (None,)], "k bigint"), "k", dim, "k")]).collect()[0].n_orphans == 2
    assert surrogate(fact, ["id"], "n").orderBy("id").first()["n"] == 1


def _cube(spark):
    fact = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (2, 1, 0.1), (2, 2, 0.3), (9, 1, 1.0)], "s int, t int, x double")
    seg = spark.createDataFrame([(1, "N", "a"), (2, "S", "b")], "s int, zone string, name string")
    tim = spark.createDataFrame([(1, 8), (2, 9)], "t int, hour int")
    return Cube(fact, {"seg": Dimension(seg, "s", ("zone", "name")), "tim": Dimension(tim, "t", ("hour",))}, {"n": rows_of(), "x": total_of("x")})


def test_cube_margins_and_routing(spark):
    cube = _cube(spark)
    rows = cube.cube(["zone", "hour"]).collect()
    got = {(r.zone, r.hour): (r.n, round(r.x, 6)) for r in rows}
    assert got[("ALL", "ALL")] == (4, 1.6) and got[("N", "ALL")][1] == 1.2 and len(rows) == 9
    cube.materialise(["zone"])
    assert {r.zone: r.n for r in cube.roll_up(["zone"]).collect()} == {"N": 2, "S": 2}
    assert cube.dice({"hour": ("between", 9, 10), "zone": ["N"]}, ["zone"]).collect()[0].n == 1
    p = cube.pivot(["zone"], "hour", (8, 9, 10), "n", "h", fill=0).orderBy("zone").collect()
    assert tuple(p[0]) == ("N", 1, 1, 0)
    assert [r.name for r in cube.top(["name"], "x", 1).collect()] == ["a"]
    assert cube.slice("zone", "S", ["hour"]).count() == 2
    assert {r.b: r.n for r in cube.compare(F.col("hour") > 8, "b", ["hour"]).collect()} == {True: 2, False: 3}


def test_measures(spark):
    t = spark.createDataFrame([("N", 1, 0.4, 1, 1, 10.0), ("N", 0, 0.2, 0, 0, 5.0), ("S", 1, 0.9, 1, 1, None)], "zone string, is_adverse int, congestion_index double, is_peak_hour int, is_congested int, vehicle_km double")
    t = t.withColumns({c: F.lit(1.0) for c in ("avg_speed_kmph", "speed_ratio", "travel_time_min", "delay_index")})
    i = spark.createDataFrame([("N", 1, 2, 3.0, 4.0, 0)], "zone string, is_major int, severity int, response_time_min double, duration_min double, casualties int")
    m = MeasureModel({"traffic": t, "incident": i}, TRAFFIC + INCIDENTS, DERIVED)
    got = {r.zone: r for r in m.query(["observations", "incidents", "incidents_per_1k_hours", "wet_weather_penalty"], ["zone"], {"is_adverse": [1]}).collect()}
    assert (got["N"].observations, got["N"].incidents, got["N"].incidents_per_1k_hours) == (1, 1, 1000.0)
    assert abs(got["N"].wet_weather_penalty - 0.2) < 1e-9 and got["S"].incidents is None and got["S"].wet_weather_penalty is None
    assert m.query(["congested_hours_pct", "major_incident_pct"]).first()[0] == pytest.approx(2 / 3)
    facts = {"anomaly": spark.createDataFrame([(1, 0), (1, 2), (0, 0)], "agreement int, incident_count int"), "forecast": spark.createDataFrame([(1.0, 1.5, 2.0)], "actual double, predicted double, persistence double"),
             "rule": spark.createDataFrame([(1.5,), (2.5,)], "lift double"), "cluster": spark.createDataFrame([(1,)], "c int")}
    row = MeasureModel(facts, MINING, DERIVED).query(["anomalies", "agreed_anomalies", "unexplained_anomalies", "forecast_lift_pct", "rules", "max_lift", "segments_clustered"]).first()
    assert tuple(row) == (3, 2, 1, 0.5, 2, 2.5, 1)


def test_time_measures_under_any_group_and_filter(spark):
    day = lambda m, d: datetime(2024, m, d).date()
    rows = [("N", day(1, 30), 1, 0.2), ("N", day(2, 2), 1, 0.4), ("N", day(2, 5), 1, 0.6), ("N", day(2, 5), 0, 0.9), ("N", day(4, 1), 1, 0.5), ("S", day(1, 9), 1, 0.8)]
    t = spark.createDataFrame(rows, "zone string, date date, hour int, congestion_index double").withColumns({"year": F.year("date"), "month": F.month("date")})
    i = t.limit(0).select("zone", "date", "year", "month")
    m = MeasureModel({"traffic": t, "incident": i}, TRAFFIC + INCIDENTS, DERIVED, TIMED)
    got = {(r.zone, r.month): (r.avg_congestion_pm, r.avg_congestion_mom, r.avg_congestion_7d) for r in m.query(["avg_congestion_pm", "avg_congestion_mom", "avg_congestion_7d"], ["zone", "month"], {"hour": [1]}).collect()}
    # February after January; March has no rows, so April has no month before; the 7 days to 5 February hold two days of values
    assert got[("N", 2)] == (pytest.approx(0.2), pytest.approx(1.5), pytest.approx((0.2 + 0.4 + 0.6) / 3)) and got[("N", 4)][0] is None and got[("S", 1)] == (None, None, pytest.approx(0.8))
    assert len(got) == 4  # no group but those that the filtered facts show
    only = m.query(["avg_congestion", "avg_congestion_pm"], ["zone"], {"month": [2], "hour": [1]}).collect()
    assert [(r.zone, round(r.avg_congestion, 6), round(r.avg_congestion_pm, 6)) for r in only] == [("N", 0.5, 0.2)]
    assert m.query(["avg_congestion_7d"]).first()[0] == pytest.approx(0.5)


def test_stored_cuboids_route_coarser_queries(spark, tmp_path):
    cube = _cube(spark)
    cube.measures = {"n": rows_of(), "avg_x": mean_of("x"), "pct": percent_of("t")}
    want = {r.zone: tuple(r) for r in cube.roll_up(["zone"]).collect()}
    cube.materialise(["zone", "hour"], path=str(tmp_path / "cuboid"))
    cube.materialise(["zone", "name", "hour"])
    cube.fact = cube.fact.limit(0)  # whatever comes now is from a cuboid
    assert {r.zone: tuple(r) for r in cube.roll_up(["zone"]).collect()} == want and cube.roll_up(["name"], ["n"]).count() == 2
    with pytest.raises(ValueError):
        Cube(cube.fact, {}, {"n": F.count(F.lit(1))}).materialise([])


def test_itemsets_and_rules(spark):
    df = spark.createDataFrame([(list(x),) for x in ("ABC", "AB", "AC", "BC", "ABC", "A")], "items array<string>")
    got = {tuple(r.itemset): r.support for r in frequent_itemsets(df, "items", 0.5).collect()}
    assert got[("A",)] == pytest.approx(5 / 6) and got[("A", "B")] == 0.5 and ("A", "B", "C") not in got
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([(sorted(rng.choice(list("ABCDEF"), rng.integers(2, 5), replace=False).tolist()),) for _ in range(300)], "items array<string>")
    sets = {tuple(r.itemset): r.support for r in frequent_itemsets(many, "items", 0.1).collect()}
    assert all(sets[s] <= sets[sub] + 1e-12 for s in sets for k in range(1, len(s)) for sub in combinations(s, k))
    three = spark.createDataFrame([(["A", "B"],)] * 6 + [(["A"],)] * 2 + [(["B"],)] * 2, "items array<string>")
    r = {(x.antecedent, x.consequent): x for x in rules(frequent_itemsets(three, "items", 0.1), 0.0, 0.0).collect()}[("A", "B")]
    assert (r.support, round(r.confidence, 6), round(r.lift, 6)) == (0.6, 0.75, 0.9375)
    assert frequent_itemsets(three.limit(0), "items", 0.1).count() == 0
    tags = spark.createDataFrame([("Collision", None)], "a string, b string").select(tagged([("TYPE", F.col("a")), ("X", F.col("b"))])).first()[0]
    assert tags == ["TYPE=Collision"]


def test_series_have_no_leak(spark):
    rows = [(START + timedelta(hours=i), float(i)) for i in range(60)]
    got = supervised(spark.createDataFrame(rows, "ts timestamp, y double"), "ts", "y", lags=(1, 2, 24)).toPandas()
    assert len(got) == 36 and (got.lag_1 == got.y - 1).all() and (got.roll_mean_3 == got.y - 2).all() and got.notna().all().all()
    split = tail_split(spark.createDataFrame(rows, "ts timestamp, y double"), "ts", 10)
    assert split.where("is_test = 1").agg(F.min("ts")).first()[0] > split.where("is_test = 0").agg(F.max("ts")).first()[0]
    m = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "a double, p double")
    assert tuple(m.agg(*regression_metrics(m, "a", "p")).first()) == (0.5, pytest.approx(0.5**0.5), 50.0, 0.5)


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "l int, p int")
    row = summary(confusion_matrix(df, "l", "p")).first()
    assert row.accuracy == 0.75 and row.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    big = spark.createDataFrame([(i, i % 3) for i in range(300)], "id int, c int")
    split = stratified_holdout(big, "c", "id")
    assert {r.c: r.n for r in split.groupBy("c").agg(F.sum("is_test").alias("n")).collect()} == {0: 25, 1: 25, 2: 25}
    assert balanced_weights(big, "c").agg(F.sum("weight")).first()[0] == pytest.approx(300)


def test_clusters(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 5))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(99, 50.0, 50.0)], "id int, x double, y double")
    lab = {r.id: r.cluster for r in dbscan(df, "id", ["x", "y"], 0.8, 3).collect()}
    assert len({lab[i] for i in range(30)}) == 1 and lab[0] != lab[40] and lab[99] == -1 and sorted(set(lab.values())) == [-1, 0, 1]
    fitted, centres, cost = kmeans_best(df.where("id < 99"), ["x", "y"], 2, (1,))
    s = silhouettes(fitted, "id", ["x", "y"], "cluster").toPandas()
    assert s.silhouette.mean() > 0.9 and len(centres) == 2
    q = cluster_indices(fitted, ["x", "y"], "cluster")
    assert q["inertia"] == pytest.approx(cost, rel=1e-6) and q["davies_bouldin"] < 0.2
    assert pca_plane(df, "id", ["x", "y"]).count() == 61
    z = standardise(df, ["x"]).agg(F.avg("z_x"), F.stddev_pop("z_x")).first()
    assert abs(z[0]) < 1e-9 and z[1] == pytest.approx(1)
    forest = IsolationForest(trees=40).fit(df, ["x", "y"], "id")
    worst = forest.transform(df).orderBy("iso_score").first()
    assert worst.id == 99


def test_io(spark, tmp_path):
    segs = generator.segments(spark, 5)
    write_csv(segs, str(tmp_path / "s"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "s"), SEGMENTS).collect())) == sorted(map(tuple, segs.collect()))
    assert write_bom_csv(segs, str(tmp_path / "x.csv")) == 5 and (tmp_path / "x.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    with pytest.raises(ValueError):
        write_bom_csv(segs, str(tmp_path / "y.csv"), 3)
    write_json({"a": 1, "_b": 2}, str(tmp_path / "r.json"))
    assert read_json(str(tmp_path / "r.json")) == {"a": 1} and read_json(str(tmp_path / "none.json")) == {}
    with pytest.raises(FileNotFoundError):
        require(str(tmp_path / "none"))
    (tmp_path / "c.json").write_text('{"seed": 7, "out_dir": "o"}')
    assert load_config(str(tmp_path / "c.json")).seed == 7 and Config().k_range == [2, 8]
    segs.createOrReplaceTempView("segs_v")
    assert read_query(spark, "SELECT * FROM segs_v WHERE segment_id = :x", x="SEG001").count() == 1
    assert dump_tables(spark, ["segs_v", "no_such"], str(tmp_path / "d")) == {"segs_v": 5}
    assert [r.table for r in manifest(spark, {"b": 1, "a": 2}, "now").collect()] == ["a", "b"]


def test_pipeline_on_generated_feed(spark, tmp_path, monkeypatch):
    from strandcube import cli
    from strandcube.queries import mining

    # the full sizes of the models are tested in test_mining_queries.py
    for name, value in (("STARTS", 2), ("REFIT_STARTS", 2), ("K_RANGE", range(2, 4))):
        monkeypatch.setattr(mining, name, value)
    small = {"severity_models": {"trees": 3}, "severity_importances": {"trees": 3}, "forecast_models": {"forest": (3, 4), "boosting": (3, 2)}}
    for name, sizes in small.items():
        full = mining.QUERIES[name]
        monkeypatch.setitem(mining.QUERIES, name, lambda s, d, full=full, sizes=sizes: full(s, d, **sizes))
    monkeypatch.setattr(mining, "HORIZON", 24)
    cfg = Config(data_dir=str(tmp_path / "in"), out_dir=str(tmp_path / "out"), n_segments=8, n_days=40)
    for s in cli.STAGES:
        getattr(cli, s)(spark, cfg)
    read = lambda n: spark.read.parquet(f"{cfg.out_dir}/{n}")
    base = read("base")
    assert base.count() == 8 * 960 and base.where("avg_speed_kmph IS NULL OR weather IS NULL").count() == 0
    assert read("agg_zone_month.parquet").agg(F.sum("n")).first()[0] == read("fact_traffic.parquet").count() == 8 * 960
    inc = read("fact_incident.parquet")
    assert inc.count() == read("incident_log").count() > 20 and inc.where("segment_key IS NULL OR incident_type_key IS NULL OR congestion_index IS NULL").count() == 0
    assert {p.name for p in (tmp_path / "out" / "olap").iterdir()} == set(cli.OLAP) and {p.name for p in (tmp_path / "out" / "mining").iterdir()} == set(cli.MINING)
    text = (tmp_path / "out" / "findings.md").read_text()
    assert "fact_traffic" in text and "## severity_models" in text and read_json(str(tmp_path / "out" / "preprocessing_report.json"))["duplicates"] > 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 40, START + timedelta(minutes=7 * (i % 40)), "ab"[i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    got = {(r.hour_start, r.kind): r.n for r in run_available(hourly_counts(read_stream(spark, str(tmp_path / "in"), "ts"), "ts", "id", "kind")).collect()}
    want = {(r.h, r.kind): r.n for r in df.dropDuplicates(["id"]).groupBy(F.date_trunc("hour", "ts").alias("h"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
    assert run_available(sessions(read_stream(spark, str(tmp_path / "in"), "ts"), "ts", "kind"), "complete").agg(F.sum("n")).first()[0] == 50


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    """Beyond the broadcast bounds the same results come from shuffled joins."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame([(f"{s}-{h}", f"S{s}", START + timedelta(hours=h), float(40 + 10 * np.sin(h / 4) + rng.normal())) for s in range(4) for h in range(300)], columns=["id", "seg", "ts", "x"])
    pdf.loc[50, "x"] = 140.0
    df = spark.createDataFrame(pdf)
    run = lambda: {tuple(r)[:3] for r in plausible.flag_implausible(df, "seg", "ts", "id", [Field("x", 0, 160, 1.0)], None, plausible.SpikeModel(block_rows=50, broadcast_blocks=bound)).collect()}
    bound = 1000
    want = run()
    for name in ("BROADCAST_CELLS", "BROADCAST_TIMES"):
        monkeypatch.setattr(effects, name, 1)
    monkeypatch.setattr(references, "BROADCAST_KEYS", 1)
    bound = 1
    assert run() == want and ("0-50", "x", "spike") in want


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70
    assert entry.entry(spark).limit(1).count() == 1
