"""Names, scores, trees and lists that the mining tasks give out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandcube.functions.labels import canonical_label, fold_columns
from strandcube.operators.clean import clean_readings, dedup_keep_first
from strandcube.operators.mining.classify import cross_validate, feature_importances, fit_classifiers, tree_rules
from strandcube.operators.mining.clusters import dbscan, kmeans_sweep, nearest_centre, silhouettes
from strandcube.operators.mining.evaluate import mark_best
from strandcube.operators.mining.profiles import cluster_summary, hotspots
from strandcube.operators.mining.rules import filtered_rules, shortened
from strandcube.operators.warehouse import fact_incident, incidents_per_hour
from strandcube.sources import generator


def test_null_keys_are_no_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "id string, t int")
    assert sorted((r.id or "", r.t) for r in dedup_keep_first(df, ["id"], ["t"]).collect()) == [("", 3), ("", 3), ("a", 1)]


def test_columns_are_folded_as_one_by_one(spark):
    df = spark.createDataFrame([("FOG", "hgihway", 1), (None, "Highway", 2), ("tbc", "", 3), ("Fog", None, 4)], "w string, r string, _at int")
    vocabularies = {"w": ["Clear", "Fog"], "r": ["Highway", "Residential"]}
    got = {r["_at"]: (r.w_label, r.r_label) for r in fold_columns(df, vocabularies).collect()}
    want = {r["_at"]: (r.a, r.b) for r in df.select("_at", canonical_label(F.col("w"), vocabularies["w"]).alias("a"), canonical_label(F.col("r"), vocabularies["r"]).alias("b")).collect()}
    assert got == want and got[1] == ("Fog", "Highway") and got[3] == (None, None)
    assert fold_columns(df.limit(0), vocabularies).count() == 0


def test_cleaning_log(spark):
    ts = pd.date_range("2024-01-01", periods=200, freq="h")
    pdf = pd.DataFrame({"reading_id": [f"r{i}" for i in range(200)], "segment_id": "S1", "timestamp": ts, "congestion_index": 0.5 + 0.01 * (np.arange(200) % 5), "weather": "Clear"})
    pdf.loc[0, "congestion_index"], pdf.loc[1, "congestion_index"], pdf.loc[2, "weather"] = 1.7, np.nan, None
    df = spark.createDataFrame(pd.concat([pdf, pdf[:3]]))
    out, log = clean_readings(df, {"congestion_index": (0.0, 1.0)}, ["Clear", "Rain"])
    assert tuple(log.first()) == (203, 3, 1, 1, 2, 0, 200)
    assert out.where("congestion_index IS NULL OR weather IS NULL").count() == 0


def test_sweep_scores_are_mean_silhouettes(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(c, 0.3, (12, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    df = spark.createDataFrame([(f"k{i:02d}", *map(float, p)) for i, p in enumerate(pts)], "key string, x double, y double")
    got = kmeans_sweep(df, ["x", "y"], {2: 5, 3: 5, 4: 5})
    for k, (_, centres, score) in got.items():
        each = silhouettes(nearest_centre(df, ["x", "y"], centres), "key", ["x", "y"], "cluster").agg(F.avg("silhouette")).first()[0]
        assert score == pytest.approx(each)
    assert max(got, key=lambda k: got[k][2]) == 3 and kmeans_sweep(df.limit(0), ["x", "y"], {2: 1}) == {}


def test_long_chains_are_one_cluster(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 400, F.col("id") * 0.5).otherwise(F.col("id") * 0.5 + 50).alias("x"))
    got = dbscan(df, "key", ["x"], 0.6, 2).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [200, 400]


def test_clusters_are_named_by_their_place(spark):
    rows = [(0, 0.9, 2.0, 1.0), (1, 0.8, 1.0, 2.0), (2, 0.5, 1.8, 3.0), (3, 0.2, 1.5, 9.0), (4, 0.1, 1.2, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, mean_congestion double, peak_ratio double, incidents_per_1k double")
    got = {r.cluster: r.label for r in cluster_summary(df, "cluster", ("mean_congestion", "peak_ratio", "incidents_per_1k")).collect()}
    assert got == {0: "Chronic peak-hour bottleneck", 1: "All-day saturated corridor", 2: "Commuter-driven corridor", 3: "Incident-prone but free-flowing", 4: "Stable low-stress segment"}
    tops = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "segment_id string, mean_congestion double")
    assert [r.segment_id for r in hotspots(tops, 2).collect()] == ["a", "b"]


def test_trees_folds_and_best(spark):
    rng = np.random.default_rng(2)
    kind, x = rng.choice(["a", "b"], 200), rng.random(200)
    pdf = pd.DataFrame({"x": x, "z": rng.random(200), "kind": kind, "label": ((x > 0.5) & (kind == "a")).astype(float), "weight": 1.0, "fold": np.arange(200) % 5})
    df = spark.createDataFrame(pdf).persist()
    models = fit_classifiers(df, ["x", "z"], ["kind"], "label", names=("decision_tree", "random_forest"), trees=5)
    text = tree_rules(models["decision_tree"], df, ["no", "yes"], 2)
    assert any("kind=" in t for t in text) and any(t.strip().startswith("|") and "class: yes" in t for t in text) and max(t.count("|   ") for t in text) <= 2
    assert {f for f, _ in feature_importances(models["random_forest"], df, 2)} <= {"x", "z", "kind=a", "kind=b"}
    scores = cross_validate(df, ["x", "z"], ["kind"], "label", names=("decision_tree",))
    assert scores[0][0] == "decision_tree" and 0.8 < scores[0][1] <= 1 and scores[0][2] >= 0
    best = mark_best(spark.createDataFrame([("m1", 0.5, 1), ("m2", 0.7, 1), ("m3", 0.9, 0), ("m0", 0.7, 1)], "model string, f1 double, ok int"), "f1", among=F.col("ok") == 1)
    assert [r.model for r in best.where("is_best = 1").collect()] == ["m0"]


def test_rule_view_and_labels(spark):
    rules = spark.createDataFrame([("a", "b", 0.1, 0.9, 2.0), ("a", "c", 0.1, 0.6, 3.0), ("b", "c", 0.1, 0.8, 1.0)], "antecedent string, consequent string, support double, confidence double, lift double")
    assert [r.consequent for r in filtered_rules(rules, 0.7, 1.3).collect()] == ["b"]
    got = spark.createDataFrame([("x" * 57,), ("y" * 58,), (None,)], "s string").select(shortened(F.col("s"))).collect()
    assert [r[0] and (len(r[0]), r[0][-3:]) for r in got] == [(57, "xxx"), (58, "..."), None]


def test_generated_weather_is_carried(spark):
    w = [r.weather for r in generator.hours(spark, 60).orderBy("h").collect()]
    same = sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)
    assert set(w) <= set(generator.WEATHER) and 0.6 < same < 0.85  # 0.55 carried, the others drawn anew
    segs = generator.segments(spark, 20)
    inc = generator.incidents(spark, segs, 30)
    clean = generator.readings(spark, segs, 30)
    assert inc.select("incident_id").distinct().count() == inc.count() > 50 and inc.where("severity NOT BETWEEN 1 AND 4 OR duration_min < 5").count() == 0
    hit = clean.join(inc.select("segment_id", "timestamp").distinct(), ["segment_id", "timestamp"])
    assert hit.where("incident_active = 0").count() == 0 and hit.agg(F.avg("congestion_index")).first()[0] > clean.agg(F.avg("congestion_index")).first()[0]


def test_incident_facts(spark):
    inc = spark.createDataFrame([("i1", "S1", "Fog", "Debris", 7), ("i2", None, None, "none such", None)], "incident_id string, segment_id string, weather string, incident_type string, severity int")
    inc = inc.withColumns({"timestamp": F.lit("2024-01-01 05:30:00").cast("timestamp"), "vehicles_involved": F.lit(1), "lanes_blocked": F.lit(2), "casualties": F.lit(0), "duration_min": F.lit(5.0), "response_time_min": F.lit(5.0)})
    traffic = spark.createDataFrame([(1, 2024010105, 0.4), (1, 2024010105, 0.6), (None, 2024010105, 0.9)], "segment_key bigint, time_key bigint, congestion_index double")
    seg, wea, typ = (spark.createDataFrame([(1, n)], f"{k} bigint, {c} string") for n, k, c in (("S1", "segment_key", "segment_id"), ("Fog", "weather_key", "weather"), ("Debris", "incident_type_key", "incident_type")))
    got = {r.incident_id: r for r in fact_incident(inc, traffic, seg, wea, typ).collect()}
    assert (got["i1"].severity, got["i1"].is_major, got["i1"].congestion_index, got["i1"].segment_key) == (4, 1, 0.6, 1)
    assert got["i2"].segment_key is None and got["i2"].congestion_index is None and got["i2"].severity is None
    hours = incidents_per_hour(inc, "segment_id", "timestamp").collect()
    assert len(hours) == 1 and (hours[0].incident_count, hours[0].total_lanes_blocked) == (1, 2)
