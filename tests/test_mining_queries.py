"""The registered mining queries do their whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcube.operators.mining import isolation
from strandcube.operators.mining.clusters import kmeans_starts, nearest_centre
from strandcube.queries import mining


def test_sweep_reaches_eight_clusters_over_eight_features(spark, monkeypatch):
    rng = np.random.default_rng(3)
    corner = rng.permutation(np.eye(8) * 10)
    pts = np.vstack([rng.normal(c, 0.2, (6, 8)) for c in corner])
    df = spark.createDataFrame([(f"S{i:02d}", *map(float, p)) for i, p in enumerate(pts)], "segment_id string, " + ", ".join(f"{c} double" for c in mining.FEATURES))
    monkeypatch.setattr(mining, "_profiles", lambda *_: df)
    got = mining.kmeans_profiles(spark, "").toPandas().sort_values("segment_id")
    labels = got.cluster.to_numpy().reshape(8, 6)
    assert (got.k == 8).all() and (labels == labels[:, :1]).all() and len(set(labels[:, 0])) == 8 and got.mean_silhouette[0] > 0.9
    assert len(mining.FEATURES) == 8 and "avg_speed_ratio" in mining.FEATURES


def test_more_starts_never_cost_more(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(rng.normal(size=(60, 3)).tolist(), "x double, y double, z double")
    one, many = (kmeans_starts(df, ["x", "y", "z"], {5: n})[5] for n in (1, 25))
    assert many[0] <= one[0] and len(many[1]) == 5
    assert nearest_centre(df, ["x", "y", "z"], many[1]).select("cluster").distinct().count() == 5


class Seen(Exception):
    pass


def test_forecasts_are_fitted_at_full_size(spark, monkeypatch):
    def fit(rows, features, y, forest=(250, 16), boosting=(400, 3), **_):
        raise Seen(forest, boosting, len(features), set(features) <= set(rows.columns))

    monkeypatch.setattr(mining, "fit_models", fit)
    with pytest.raises(Seen) as e:
        mining.forecast_models(spark, "/root/testdata/sf0.001")
    assert e.value.args == ((250, 16), (400, 3), 18, True)


def test_severity_uses_all_features_and_trees(spark, monkeypatch):
    def fit(rows, numeric, categorical, label, trees=300, **_):
        raise Seen(rows, numeric, categorical, trees)

    monkeypatch.setattr(mining, "fit_classifiers", fit)
    with pytest.raises(Seen) as e:
        mining.severity_models(spark, "/root/testdata/sf0.001")
    rows, numeric, categorical, trees = e.value.args
    assert (len(numeric), len(categorical), trees) == (15, 5, 300) and not {"duration_min", "response_time_min", "casualties"} & {*numeric}
    assert {*numeric, *categorical} <= {*rows.columns}
    whole = mining._severity_rows(spark, "/root/testdata/sf0.001").toPandas()
    assert len(whole) and whole.incident_key.is_unique and whole.congestion_index.notna().all() and whole.time_of_day.nunique() > 1
    assert (whole.blocked_lane_ratio.dropna() - (whole.lanes_blocked / whole.lanes.clip(lower=1)).dropna()).abs().max() < 1e-3


def test_isolation_trees_draw_from_all_rows(spark, monkeypatch):
    drawn = []
    grow = isolation._grow
    monkeypatch.setattr(isolation, "_grow", lambda x, rng, limit: drawn.append(x[:, 0]) or grow(x[:, :1], rng, 1))
    df = spark.range(25_000).select("id", F.col("id").cast("double").alias("x"))
    for trees, least in ((4, 1024), (200, 20_001)):  # apart while the rows last, then from the whole table
        drawn.clear()
        isolation.IsolationForest(trees).fit(df, ["x"], "id")
        assert len(drawn) == trees and all(len(set(d)) == 256 for d in drawn) and len(set(np.concatenate(drawn))) >= least


def test_isolation_scores_follow_the_trees():
    x = np.random.default_rng(5).normal(size=(400, 3))
    forest, limit = isolation.IsolationForest(1), 6
    nodes = isolation._grow(x[:64], np.random.default_rng(6), limit)
    forest.forest, forest.limit, forest.norm = [isolation._heap(nodes, limit)], limit, 1.0

    def walk(p, i=0):
        f, at, left, right, length = nodes[i]
        return length if f < 0 else walk(p, left if p[f] < at else right)

    assert np.allclose(forest._score(x), [-(2.0 ** -walk(p)) for p in x])


def test_isolation_query_grows_200_trees(spark, monkeypatch):
    def forest(trees=200, **_):
        raise Seen(trees)

    monkeypatch.setattr(mining, "IsolationForest", forest)
    with pytest.raises(Seen) as e:
        mining.isolation_flags(spark, "/root/testdata/sf0.001")
    assert e.value.args == (200,)


def test_generated_feed_has_the_configured_size(spark):
    n = mining.generated_feed(spark, "").agg(F.sum("n")).first()[0]
    assert 60 * 365 * 24 <= n <= 1.02 * 60 * 365 * 24
