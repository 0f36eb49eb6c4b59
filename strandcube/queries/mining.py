"""Mining and streaming queries, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact_avg
from strandcube.functions.calendar import DURATION_BANDS, LANE_BANDS, RESPONSE_BANDS, SEVERITY_LABELS, VEHICLE_BANDS, add_time_features, band, congestion_level, is_congested
from strandcube.functions.values import present
from strandcube.operators.clean import seasonal_z
from strandcube.operators.mining.classify import MODELS, cross_validate, feature_importances, fit_classifiers, to_label, tree_rules
from strandcube.operators.mining.clusters import cluster_indices, dbscan, kmeans_sweep, nearest_centre, neighbour_pairs, pca_plane, silhouettes, standardise
from strandcube.operators.mining.evaluate import balanced_weights, class_report, confusion_matrix, mark_best, rank_fraction, regression_metrics, stratified_holdout, summary
from strandcube.operators.mining.isolation import IsolationForest
from strandcube.operators.mining.profiles import cluster_summary, hotspots
from strandcube.operators.mining.profiles import segment_profiles as profiles
from strandcube.operators.mining.rules import filtered_rules, frequent_itemsets, rules, shortened, tagged, top_rules
from strandcube.operators.mining.series import fit_models, predict, supervised, tail_split
from strandcube.plans.measures import DERIVED, MINING, MeasureModel
from strandcube.queries.common import T_SQL, davg, incident_cube, traffic, traffic_cube
from strandcube.queries.prepare import _bands
from strandcube.session import cut, kept
from strandcube.sources import generator
from strandcube.sources.io import Config
from strandcube.sources.tables import table
from strandcube.streaming.windows import hourly_counts, read_stream, run_available

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, HORIZON = 0.05, 0.55, 1.1, 168
FEATURES = ("mean_congestion", "p95_congestion", "congested_share", "peak_ratio", "weekend_ratio", "wet_penalty", "incidents_per_1k", "avg_speed_ratio")
# The days of the week in order.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: The k that are tried, the starts of each and those of the refit.
K_RANGE, STARTS, REFIT_STARTS = range(2, 9), 25, 50


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traffic_cube(spark, sf_dir).star(["segment_id", "zone", "is_peak_hour", "is_weekend", "is_adverse"])
    return profiles(rows, ["segment_id", "zone"])


def segment_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).drop("avg_speed_ratio")


def rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_fraction(segment_profiles(spark, sf_dir).select("segment_id", "incident_total"), "incident_total", "pct")
    return out.select("segment_id", F.round("pct", 8).alias("pct"))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traffic_cube(spark, sf_dir).star(["timestamp"])
    return rows.groupBy("timestamp").agg(exact_avg(F.col("congestion_index")).alias("y"), exact_avg(F.col("avg_speed_kmph")).alias("speed"), F.coalesce(F.sum("incident_count"), F.lit(0)).alias("incident_total"))


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised(hourly_series(spark, sf_dir), "timestamp", "y", ["speed", "incident_total"])


_LAG_COLUMNS = ["lag_1", "lag_2", "lag_3", "lag_24", "lag_168", "roll_mean_3", "roll_mean_24", "roll_std_24", "speed_lag_1", "incident_total_lag_1"]


def supervised_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.date_format("timestamp", "yyyyMMddHH").cast("bigint").alias("time_key")
    return _lags(spark, sf_dir).select(key, *[F.round(c, 8 if c == "roll_std_24" else 12).alias(c) for c in ["y", *_LAG_COLUMNS]])


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence and seasonal-naive errors over the last 168 hours."""
    test = tail_split(_lags(spark, sf_dir), "timestamp", HORIZON).where("is_test = 1")
    out = None
    for name, c in (("persistence", "lag_1"), ("seasonal_naive", "lag_168")):
        one = test.agg(*regression_metrics(test, "y", c)).select(F.lit(name).alias("model"), *[F.round(m, 8).alias(m) for m in ("mae", "rmse", "mape", "r2")])
        out = one if out is None else out.unionByName(one)
    return out


def _incident_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident_cube(spark, sf_dir).star(["incident_type", "weather", "road_type", "zone", "time_of_day", "is_peak_hour", "is_weekend"])
    c = F.col
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_LABELS for x in kv]), c("severity"))
    tags = [
        ("TYPE", c("incident_type")), ("WEATHER", c("weather")), ("ROAD", c("road_type")), ("ZONE", c("zone")), ("TIME", c("time_of_day")),
        ("PEAK", F.when(c("is_peak_hour") == 1, "Yes").otherwise("No")), ("DAY", F.when(c("is_weekend") == 1, "Weekend").otherwise("Weekday")), ("CONGESTION", congestion_level(present(c("congestion_index")))),
        ("LANES_BLOCKED", band(c("lanes_blocked"), LANE_BANDS, -1)), ("VEHICLES", band(c("vehicles_involved"), VEHICLE_BANDS, 0)), ("DURATION", band(c("duration_min"), DURATION_BANDS, -1)),
        ("RESPONSE", band(c("response_time_min"), RESPONSE_BANDS, -1)), ("SEVERITY", severity),
    ]
    return rows.select("incident_key", tagged(tags).alias("items"))


def itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequent_itemsets(_incident_tags(spark, sf_dir), "items", MIN_SUPPORT)
    return found.select(F.array_join("itemset", ", ").alias("itemset"), "size", "n", "support")


def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules(frequent_itemsets(_incident_tags(spark, sf_dir), "items", MIN_SUPPORT), MIN_CONFIDENCE, MIN_LIFT)
    return found.select("antecedent", "consequent", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift", "leverage", "conviction")])


def rule_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 strongest rules whose consequent starts with a severity."""
    return top_rules(association_rules(spark, sf_dir).where(F.col("consequent").startswith("SEVERITY=")), 25)


def rules_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 strongest rules of confidence 0.7 and lift 1.3 or more."""
    return filtered_rules(association_rules(spark, sf_dir), 0.7, 1.3)


def itemset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent sets per size."""
    return itemsets(spark, sf_dir).groupBy("size").agg(F.count(F.lit(1)).alias("n_sets"))


def top_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 sets of greatest support (ties by name), with a label of bounded length."""
    return itemsets(spark, sf_dir).orderBy(F.desc("n"), "itemset").limit(25).select("itemset", "n", shortened(F.col("itemset")).alias("label"))


def ordered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents per severity and weekday with the places of both in their own order."""
    rows = incident_cube(spark, sf_dir).star(["day_name"]).where("severity BETWEEN 1 AND 4")
    counts = rows.groupBy("severity", "day_name").agg(F.count(F.lit(1)).alias("n"))
    days = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "day_name string, day_order int")
    labels = spark.createDataFrame(list(SEVERITY_LABELS), "severity int, severity_label string")
    out = counts.join(F.broadcast(days), "day_name").join(F.broadcast(labels), "severity")
    return out.select("severity_label", F.col("severity").alias("severity_order"), "day_name", "day_order", "n").orderBy("severity_order", "day_order")


def _severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fact_incident").where("severity IS NOT NULL AND lanes_blocked IS NOT NULL")
    return confusion_matrix(f.select("severity", F.least(F.col("lanes_blocked") + 1, F.lit(4)).alias("guess")), "severity", "guess")


def severity_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _severity_matrix(spark, sf_dir)


def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_report(_severity_matrix(spark, sf_dir)).select("label", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a rule-based guess in tall form: metric, value."""
    out = summary(_severity_matrix(spark, sf_dir)).withColumn("_k", F.lit(0))
    return out.unpivot(["_k"], ["accuracy", "macro_precision", "macro_recall", "macro_f1"], "metric", "value").select("metric", F.round("value", 8).alias("value"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dim_segment").where("latitude IS NOT NULL AND longitude IS NOT NULL").select("segment_id", "zone", (F.col("latitude") * 100).alias("x"), (F.col("longitude") * 100).alias("y"))


def dbscan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments within 2 hundredths of a degree, counted over grid cells."""
    pairs = neighbour_pairs(_positions(spark, sf_dir), "segment_id", ["x", "y"], 2.0)
    return pairs.groupBy(F.col("a").alias("segment_id")).agg(F.count(F.lit(1)).alias("n_neighbours"))


def silhouette_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean silhouette of segments labelled by zone."""
    rows = _positions(spark, sf_dir).where("zone IS NOT NULL").withColumn("zone", F.lower("zone"))
    return silhouettes(rows, "segment_id", ["x", "y"], "zone").select("segment_id", F.round("silhouette", 8).alias("silhouette"))


def dbscan_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN of standardised position and congestion."""
    where = table(spark, sf_dir, "dim_segment").select("segment_id", "latitude", "longitude")
    rows = segment_profiles(spark, sf_dir).select("segment_id", "mean_congestion").join(where, "segment_id").dropna()
    z = standardise(rows, ["latitude", "longitude", "mean_congestion"])
    return dbscan(z, "segment_id", ["z_latitude", "z_longitude", "z_mean_congestion"], 0.65, 3)


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict]:
    z = cut(standardise(cut(_profiles(spark, sf_dir).dropna()), FEATURES))
    cols = [f"z_{c}" for c in FEATURES]
    tried = kmeans_sweep(z, cols, {k: STARTS for k in K_RANGE if k < z._counted})
    if not tried:
        raise ValueError(f"{z._counted} profiles are too few for a choice of k")
    return z, cols, tried


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], int, float, float]:
    """Profiles with the cluster of the refit at the k of best mean silhouette (ties: the smaller k), and k, inertia and silhouette."""
    return kept(spark, sf_dir, "clusters", lambda: _refit(*kept(spark, sf_dir, "sweep", lambda: _sweep(spark, sf_dir))))


def _refit(z: DataFrame, cols: list[str], tried: dict) -> tuple[DataFrame, list[str], int, float, float]:
    k = min(tried, key=lambda k: (-tried[k][2], k))
    inertia, centres, score = kmeans_sweep(z, cols, {k: REFIT_STARTS})[k]
    return cut(nearest_centre(z, cols, centres)), cols, k, inertia, score


def kmeans_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of standardised profiles for the k in 2..8 of best mean silhouette (25 starts each), refitted with 50 starts, with quality indices."""
    fitted, cols, k, inertia, score = _clustered(spark, sf_dir)
    q = cluster_indices(fitted, cols, "cluster")
    return fitted.select("segment_id", "cluster", F.lit(k).alias("k"), F.lit(float(score)).alias("mean_silhouette"), F.lit(inertia).alias("inertia"), F.lit(q["davies_bouldin"]).alias("davies_bouldin"), F.lit(q["calinski_harabasz"]).alias("calinski_harabasz"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> list[tuple[int, float, float, float, float]]:
    z, cols, tried = kept(spark, sf_dir, "sweep", lambda: _sweep(spark, sf_dir))
    out = []
    for k, (inertia, centres, score) in sorted(tried.items()):
        q = cluster_indices(nearest_centre(z, cols, centres), cols, "cluster")
        out.append((k, float(inertia), float(score), q["davies_bouldin"], q["calinski_harabasz"]))
    return out


def kmeans_sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia, mean silhouette, Davies-Bouldin and Calinski-Harabasz of each k of the sweep."""
    return spark.createDataFrame(_diagnostics(spark, sf_dir), "k int, inertia double, mean_silhouette double, davies_bouldin double, calinski_harabasz double")


def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean profile and name of each k-means cluster."""
    return cluster_summary(_clustered(spark, sf_dir)[0], "cluster", FEATURES)


def zone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summary and names for the zones in place of clusters."""
    return cluster_summary(_profiles(spark, sf_dir).withColumn("zone", F.lower("zone")).where("zone IS NOT NULL"), "zone", FEATURES).select("zone", "segments", "label")


def hotspot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most congested segments."""
    return hotspots(_profiles(spark, sf_dir)).select("segment_id", "zone", "mean_congestion", "p95_congestion", "incidents_per_1k")


def pca_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_plane(_profiles(spark, sf_dir).dropna(), "segment_id", FEATURES)


NUMERIC = (
    "vehicles_involved", "lanes_blocked", "blocked_lane_ratio", "lanes", "length_km", "speed_limit_kmph", "congestion_index", "avg_speed_kmph", "speed_ratio",
    "occupancy_pct", "flow_per_lane", "hour", "day_of_week", "is_weekend", "is_peak_hour",
)
CATEGORICAL = ("incident_type", "weather", "road_type", "zone", "time_of_day")
#: Fitted apart from the others, as the importances need nothing else.
FOREST = ("random_forest",)


def _severity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the features of segment, calendar and their hour's traffic; those without a congestion of their hour are dropped."""
    at, state = ["segment_key", "time_key"], ["congestion_index", "avg_speed_kmph", "speed_ratio", "occupancy_pct", "flow_per_lane"]
    rows = incident_cube(spark, sf_dir).star([*CATEGORICAL, "hour", "timestamp", "is_weekend", "is_peak_hour"]).where("severity BETWEEN 1 AND 4").drop("congestion_index")
    t = traffic(spark, sf_dir).where("congestion_index IS NOT NULL").select(*at, "traffic_key", *state)
    t = t.join(rows.select(*at).distinct(), at, "left_semi")
    # of an hour with several readings the most congested one, as in incident_features
    context = t.groupBy(*at).agg(F.max_by(F.struct(*state), F.struct("congestion_index", "traffic_key")).alias("_c")).select(*at, "_c.*")
    segment = table(spark, sf_dir, "dim_segment").select("segment_key", "lanes", "length_km", "speed_limit_kmph")
    rows = rows.join(context, at).join(segment, "segment_key")
    lanes = F.when(F.col("lanes").isNotNull(), F.greatest("lanes", F.lit(1)))
    rows = rows.withColumns({"day_of_week": F.weekday("timestamp"), "blocked_lane_ratio": F.round(F.col("lanes_blocked") / lanes, 3)})
    return rows.select("incident_key", "severity", *[F.col(c).cast("double").alias(c) for c in NUMERIC], *[F.coalesce(c, F.lit("?")).alias(c) for c in CATEGORICAL])


def _severity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stratified_holdout(_severity_rows(spark, sf_dir), "severity", "incident_key")
    return cut(balanced_weights(to_label(rows, "severity"), "severity"))


def _severity_fit(spark: SparkSession, sf_dir: str, trees: int, names: tuple[str, ...]) -> dict:
    """The classifiers named, fitted to the training part."""
    rows = kept(spark, sf_dir, "severity rows", lambda: _severity_split(spark, sf_dir))
    return kept(spark, sf_dir, f"severity {trees} {names}", lambda: fit_classifiers(rows.where("is_test = 0"), NUMERIC, CATEGORICAL, "label", trees=trees, names=names))


def severity_models(spark: SparkSession, sf_dir: str, trees: int = 300) -> DataFrame:
    """Hold-out accuracy and macro averages of four classifiers of severity, with the best by macro-F1."""
    models = _severity_fit(spark, sf_dir, trees, FOREST) | _severity_fit(spark, sf_dir, trees, tuple(m for m in MODELS if m not in FOREST))
    rows = kept(spark, sf_dir, "severity rows", lambda: _severity_split(spark, sf_dir))
    out = None
    for name in MODELS:
        m = models[name]
        one = summary(cut(confusion_matrix(m.transform(rows.where("is_test = 1")), "label", "prediction"))).select(F.lit(name).alias("model"), "accuracy", "macro_precision", "macro_recall", "macro_f1")
        out = one if out is None else out.unionByName(one)
    return mark_best(out, "macro_f1")


def severity_cv(spark: SparkSession, sf_dir: str, trees: int = 300) -> DataFrame:
    """Mean and deviation of each classifier's accuracy over five stratified folds of the training part."""
    got = kept(spark, sf_dir, f"folds {trees}", lambda: cross_validate(kept(spark, sf_dir, "severity rows", lambda: _severity_split(spark, sf_dir)).where("is_test = 0"), NUMERIC, CATEGORICAL, "label", trees=trees))
    return spark.createDataFrame(got, "model string, cv_accuracy_mean double, cv_accuracy_std double")


def severity_importances(spark: SparkSession, sf_dir: str, trees: int = 300) -> DataFrame:
    """The 15 strongest features of the random forest."""
    model = _severity_fit(spark, sf_dir, trees, FOREST)["random_forest"]
    rows = kept(spark, sf_dir, "severity rows", lambda: _severity_split(spark, sf_dir))
    return spark.createDataFrame(feature_importances(model, rows), "feature string, importance double")


def severity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision tree as text to a depth of four, a line a row."""
    train = _severity_split(spark, sf_dir).where("is_test = 0")
    model = fit_classifiers(train, NUMERIC, CATEGORICAL, "label", names=("decision_tree",))["decision_tree"]
    lines = tree_rules(model, train, [t for _, t in SEVERITY_LABELS])
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, rule string")


#: The 18 features of the forecasts.
FORECAST_FEATURES = ("lag_1", "lag_2", "lag_3", "lag_24", "lag_168", "roll_mean_3", "roll_mean_24", "roll_std_24", "incident_total_lag_1", "wet_lag_1", "hour", "day_of_week", "is_weekend", "month", "hour_sin", "hour_cos", "dow_sin", "dow_cos")


def _forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traffic_cube(spark, sf_dir).star(["timestamp", "weather"])
    wet = F.col("weather").isin("Rain", "Heavy Rain").cast("double")
    series = rows.groupBy("timestamp").agg(exact_avg(F.col("congestion_index")).alias("y"), F.coalesce(F.sum("incident_count"), F.lit(0)).alias("incident_total"), F.avg(wet).alias("wet"))
    lagged = add_time_features(supervised(series, "timestamp", "y", ["incident_total", "wet"]), "timestamp")
    return tail_split(lagged, "timestamp", HORIZON)


def _forecasts(spark: SparkSession, sf_dir: str, **sizes: tuple[int, int]) -> DataFrame:
    """The held-out rows with the predictions of all models."""
    def fit() -> DataFrame:
        rows = cut(_forecast_rows(spark, sf_dir))
        models = fit_models(rows.where("is_test = 0"), FORECAST_FEATURES, "y", **sizes)
        return cut(predict(models, rows.where("is_test = 1"), FORECAST_FEATURES).drop("_x"))

    return kept(spark, sf_dir, f"forecasts {sizes}", fit)


PREDICTED = {"persistence": "lag_1", "seasonal_naive": "lag_168", "ridge": "pred_ridge", "random_forest": "pred_random_forest", "gradient_boosting": "pred_gradient_boosting"}


def forecast_models(spark: SparkSession, sf_dir: str, forest: tuple[int, int] = (250, 16), boosting: tuple[int, int] = (400, 3)) -> DataFrame:
    """One-step forecasts of the last 168 hours: actual, persistence and three models."""
    out = _forecasts(spark, sf_dir, forest=forest, boosting=boosting)
    return out.select(F.date_format("timestamp", "yyyyMMddHH").cast("bigint").alias("time_key"), F.col("y").alias("actual"), F.col("lag_1").alias("persistence"), *[p for p in PREDICTED.values() if p.startswith("pred_")])


def _forecast_scores(out: DataFrame) -> DataFrame:
    """Errors of the baselines and the models, the best model by absolute error, and its lead over persistence in percent."""
    scores = None
    for name, c in PREDICTED.items():
        one = out.agg(*regression_metrics(out, "y", c)).select(F.lit(name).alias("model"), "mae", "rmse", "mape", "r2")
        scores = one if scores is None else scores.unionByName(one)
    fitted = ~F.col("model").isin("persistence", "seasonal_naive")
    marked = mark_best(scores, "mae", False, fitted)
    naive = F.max(F.when(F.col("model") == "persistence", F.col("mae"))).over(Window.partitionBy(F.lit(1)))  # a row per model
    return marked.withColumn("lead_pct", F.when(fitted, (1 - F.col("mae") / F.nullif(naive, F.lit(0.0))) * 100))


def forecast_scores(spark: SparkSession, sf_dir: str, forest: tuple[int, int] = (250, 16), boosting: tuple[int, int] = (400, 3)) -> DataFrame:
    return _forecast_scores(_forecasts(spark, sf_dir, forest=forest, boosting=boosting))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic rows with isolation score and flag (lowest 1 %), seasonal z and flag, and their agreement."""
    return kept(spark, sf_dir, "anomalies", lambda: _score(spark, sf_dir))


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["congestion_index", "avg_speed_kmph", "occupancy_pct", "travel_time_min", "vehicle_count"]
    rows = traffic_cube(spark, sf_dir).star(["zone", "road_type", "segment_id", "timestamp", "day_name", "hour"])
    rows = rows.withColumns({c: present(F.col(c)) for c in cols}).dropna(subset=cols)
    rows = seasonal_z(rows, "congestion_index", ["segment_key", "day_name", "hour"])
    scored = IsolationForest(trees=200).fit(rows, cols, "traffic_key").transform(rows)
    incidents = F.coalesce("incident_count", F.lit(0)).alias("incident_count")
    scored = cut(scored.select("traffic_key", "segment_id", "timestamp", "zone", "road_type", "congestion_index", "avg_speed_kmph", "seasonal_z", "iso_score", "is_seasonal_anomaly", incidents))
    limit = scored.agg(F.percentile_approx("iso_score", 0.01, 10_000)).first()[0]
    return scored.withColumn("is_iso", (F.col("iso_score") <= F.lit(limit)).cast("int")).withColumn("agreement", F.col("is_iso").bitwiseAND(F.col("is_seasonal_anomaly")))


def isolation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flagged by the isolation forest (lowest 1 %), by seasonal z, and by both, with the rate, per zone."""
    return _scored(spark, sf_dir).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_iso").alias("n_iso"), (F.avg("is_iso") * 100).alias("iso_rate_pct"), F.sum("is_seasonal_anomaly").alias("n_seasonal"), F.sum("agreement").alias("n_agreed"),
        F.sum(F.when(F.col("incident_count") == 0, F.col("agreement")).otherwise(0)).alias("n_unexplained"),
    )


def lowest_scores(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The n lowest isolation scores among the rows both detectors flag."""
    return _scored(spark, sf_dir).where("agreement = 1").orderBy("iso_score", "traffic_key").limit(n)


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows the isolation forest flags: what is kept of the anomalies."""
    return _scored(spark, sf_dir).where("is_iso = 1")


def flagged_hours(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    """The n greatest seasonal deviations among hours that both detectors flag and that have no incident."""
    return _scored(spark, sf_dir).where("agreement = 1 AND incident_count = 0").orderBy(F.desc("seasonal_z"), "traffic_key").limit(n)


def measures_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures over anomalies, forecast (ridge), rules and clusters."""
    rows = _forecast_rows(spark, sf_dir).persist()
    ridge = predict(fit_models(rows.where("is_test = 0"), FORECAST_FEATURES, "y", names=("ridge",)), rows.where("is_test = 1"), FORECAST_FEATURES)
    facts = {
        "anomaly": flagged_rows(spark, sf_dir), "rule": association_rules(spark, sf_dir), "cluster": kmeans_profiles(spark, sf_dir),
        "forecast": ridge.select(F.col("y").alias("actual"), F.col("pred_ridge").alias("predicted"), F.col("lag_1").alias("persistence")),
    }
    return MeasureModel(facts, MINING, DERIVED).query(["anomalies", "agreed_anomalies", "unexplained_anomalies", "forecast_mae", "persistence_mae", "forecast_lift_pct", "rules", "max_lift", "segments_clustered"])


def measures_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MeasureModel({"rule": association_rules(spark, sf_dir)}, MINING, DERIVED).query(["rules", "max_lift"])


def measures_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast measures with the seasonal-naive baseline as the forecast."""
    test = tail_split(_lags(spark, sf_dir), "timestamp", HORIZON).where("is_test = 1")
    fact = test.select(F.col("y").alias("actual"), F.col("lag_168").alias("predicted"), F.col("lag_1").alias("persistence"))
    out = MeasureModel({"forecast": fact}, MINING, DERIVED).query(["forecast_mae", "persistence_mae", "forecast_lift_pct"])
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all mining tasks in tall form: task, model, metric, value."""
    tall = lambda df, task, names: df.withColumn("task", F.lit(task)).unpivot(["task", "model"], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    severity = severity_models(spark, sf_dir)
    parts = [tall(severity, "Classification", ["accuracy", "macro_precision", "macro_recall", "macro_f1"]), tall(severity_cv(spark, sf_dir), "Classification", ["cv_accuracy_mean"])]
    parts.append(tall(forecast_scores(spark, sf_dir), "Forecasting", ["mae", "rmse", "mape", "r2"]))
    sweep = kmeans_sweep_scores(spark, sf_dir).withColumn("model", F.concat(F.lit("k="), F.col("k").cast("string")))
    parts.append(tall(sweep, "Clustering", ["mean_silhouette", "davies_bouldin", "calinski_harabasz", "inertia"]))
    flags = isolation_flags(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in ("n", "n_iso", "n_seasonal", "n_agreed", "n_unexplained")]).withColumn("model", F.lit("ensemble"))
    parts.append(tall(flags, "Anomaly detection", ["n", "n_iso", "n_seasonal", "n_agreed", "n_unexplained"]))
    counts = _incident_tags(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_transactions")).withColumn("n_rules", F.lit(association_rules(spark, sf_dir).count())).withColumn("model", F.lit("level-wise"))
    parts.append(tall(counts, "Association rules", ["n_transactions", "n_rules"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type from a stream over the event file."""
    counts = run_available(hourly_counts(read_stream(spark, sf_dir, "ts", "events.parquet"), "ts", "event_id", "event_type"))
    return counts.select(F.date_format("hour_start", "yyyyMMddHH").cast("bigint").alias("hour_key"), "event_type", "n")


def generated_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per road type of a generated and spoiled feed of the configured size (60 segments and 365 days), with its congested share."""
    cfg = Config()
    segs = generator.segments(spark, cfg.n_segments)
    feed = generator.spoil(generator.readings(spark, segs, cfg.n_days))
    rows = feed.join(F.broadcast(segs.select("segment_id", "road_type")), "segment_id")
    return rows.groupBy("road_type").agg(F.count(F.lit(1)).alias("n"), exact_avg(is_congested(F.col("congestion_index"))).alias("congested_share"))


QUERIES = {f.__name__: f for f in (
    segment_profiles, rank_pct, hourly_series, supervised_lags, baseline_metrics, itemsets, association_rules, rule_explorer, rules_filtered, itemset_sizes, top_itemsets, ordered_counts, severity_confusion, severity_report, severity_summary,
    dbscan_neighbours, silhouette_zones, dbscan_hotspots, kmeans_profiles, kmeans_sweep_scores, cluster_names, zone_names, hotspot_segments, pca_profiles, severity_models, severity_cv, severity_importances, severity_rules, forecast_models, forecast_scores,
    isolation_flags, lowest_scores, flagged_rows, flagged_hours, measures_mining, measures_rules, measures_baselines, model_metrics, stream_hourly_windows, generated_feed)}

_A = lambda flag, v: davg(f"CASE WHEN {flag} = {v} THEN congestion_index END")
_PROFILES = f"""{T_SQL}, p AS (SELECT segment_id, zone, count(*) AS n_rows, {davg('congestion_index')} AS mean_congestion, round(quantile_cont(congestion_index, 0.95), 8) AS p95_congestion, {davg('is_congested')} AS congested_share,
  coalesce(CAST(sum(incident_count) AS BIGINT), 0) AS incident_total, coalesce(({_A('is_peak_hour', 1)}) / nullif({_A('is_peak_hour', 0)}, 0), 0) AS peak_ratio, coalesce(({_A('is_weekend', 1)}) / nullif({_A('is_weekend', 0)}, 0), 0) AS weekend_ratio,
  coalesce({_A('is_adverse', 1)} - {_A('is_adverse', 0)}, 0) AS wet_penalty, coalesce(CAST(sum(incident_count) AS DOUBLE), 0) * 1000 / count(*) AS incidents_per_1k
  FROM t JOIN dim_segment USING (segment_key) JOIN dim_time USING (time_key) JOIN dim_weather USING (weather_key) GROUP BY ALL)"""
_SERIES = f"""{T_SQL}, s AS (SELECT timestamp, {davg('congestion_index')} AS y, {davg('avg_speed_kmph')} AS speed, coalesce(CAST(sum(incident_count) AS BIGINT), 0) AS incident_total FROM t JOIN dim_time USING (time_key) GROUP BY ALL)"""
_ROLL = "CASE WHEN count(y) OVER r{k} >= {k} THEN {f}(y) OVER r{k} END"
_LAGGED = f"""{_SERIES}, l AS (SELECT timestamp, y, {', '.join(f'lag(y, {k}) OVER w AS lag_{k}' for k in (1, 2, 3, 24, 168))}, {_ROLL.format(k=3, f='avg')} AS roll_mean_3, {_ROLL.format(k=24, f='avg')} AS roll_mean_24,
  {_ROLL.format(k=24, f='stddev_samp')} AS roll_std_24, lag(speed) OVER w AS speed_lag_1, lag(incident_total) OVER w AS incident_total_lag_1 FROM s
  WINDOW w AS (ORDER BY timestamp), r3 AS (ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r24 AS (ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
f AS (SELECT * FROM l WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _LAG_COLUMNS)})"""
_METRIC = "SELECT '{n}' AS model, round(avg(abs(y - {c})), 8) AS mae, round(sqrt(avg((y - {c}) * (y - {c}))), 8) AS rmse, round(avg(abs(y - {c}) / abs(nullif(y, 0))) * 100, 8) AS mape, round(1 - sum((y - {c}) * (y - {c})) / (sum(y * y) - count(y) * avg(y) * avg(y)), 8) AS r2 FROM x"
_TAGS = {
    "TYPE": "incident_type", "WEATHER": "weather", "ROAD": "road_type", "ZONE": "zone", "TIME": "time_of_day", "PEAK": "CASE WHEN is_peak_hour = 1 THEN 'Yes' ELSE 'No' END", "DAY": "CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END",
    "CONGESTION": "CASE WHEN isnan(congestion_index) OR congestion_index < 0 THEN NULL WHEN congestion_index <= 0.35 THEN 'Free flow' WHEN congestion_index <= 0.6 THEN 'Light' WHEN congestion_index <= 0.8 THEN 'Moderate' WHEN congestion_index <= 1.01 THEN 'Severe' END",
    "LANES_BLOCKED": _bands("lanes_blocked", LANE_BANDS, -1), "VEHICLES": _bands("vehicles_involved", VEHICLE_BANDS, 0), "DURATION": _bands("duration_min", DURATION_BANDS, -1), "RESPONSE": _bands("response_time_min", RESPONSE_BANDS, -1),
    "SEVERITY": "CASE severity WHEN 1 THEN 'Minor' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Serious' WHEN 4 THEN 'Critical' END",
}
_SETS = f"""b AS (SELECT incident_key, list_filter([{', '.join(f"'{k}=' || ({v})" for k, v in _TAGS.items())}], lambda x: x IS NOT NULL) AS items
  FROM fact_incident JOIN dim_segment USING (segment_key) JOIN dim_time USING (time_key) JOIN dim_weather USING (weather_key) JOIN dim_incident_type USING (incident_type_key)),
n AS (SELECT count(*) AS total FROM b), u AS (SELECT incident_key, unnest(items) AS i FROM b),
one AS (SELECT i, count(*) AS c FROM u GROUP BY ALL HAVING count(*) >= {MIN_SUPPORT} * (SELECT total FROM n)), v AS (SELECT incident_key, i FROM u SEMI JOIN one USING (i)),
two AS (SELECT x.i AS i, y.i AS j, count(*) AS c FROM v x JOIN v y ON x.incident_key = y.incident_key AND x.i < y.i GROUP BY ALL HAVING count(*) >= {MIN_SUPPORT} * (SELECT total FROM n)),
three AS (SELECT x.i AS i, y.i AS j, z.i AS k, count(*) AS c FROM v x JOIN v y ON x.incident_key = y.incident_key AND x.i < y.i JOIN v z ON z.incident_key = y.incident_key AND y.i < z.i GROUP BY ALL HAVING count(*) >= {MIN_SUPPORT} * (SELECT total FROM n)),
sets AS (SELECT [i] AS s, c FROM one UNION ALL SELECT [i, j], c FROM two UNION ALL SELECT [i, j, k], c FROM three),
named AS (SELECT s, array_to_string(s, ', ') AS itemset, CAST(len(s) AS INT) AS size, c AS n, CAST(c AS DOUBLE) / total AS support FROM sets, n)"""
_RULES = f"""{_SETS}, m AS (SELECT *, unnest(generate_series(1, CAST(power(2, size) AS BIGINT) - 2)) AS m FROM named WHERE size >= 2),
p AS (SELECT support, array_to_string(list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1), ', ') AS antecedent, array_to_string(list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 0), ', ') AS consequent FROM m),
q AS (SELECT antecedent, consequent, p.support, a.support AS sa, c.support AS sc, p.support / a.support AS confidence, p.support / a.support / c.support AS lift FROM p JOIN named a ON a.itemset = antecedent JOIN named c ON c.itemset = consequent),
rules AS (SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support - sa * sc, 6) AS leverage, round((1 - sc) / nullif(1 - confidence, 0), 6) AS conviction FROM q WHERE confidence >= {MIN_CONFIDENCE} AND lift >= {MIN_LIFT})"""
_GUESS = "g AS (SELECT severity AS label, least(lanes_blocked + 1, 4) AS prediction, count(*) AS n FROM fact_incident WHERE severity IS NOT NULL AND lanes_blocked IS NOT NULL GROUP BY ALL)"
_CLASSES = f"""{_GUESS}, a AS (SELECT label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS BIGINT) AS hits FROM g GROUP BY ALL), b AS (SELECT prediction AS label, CAST(sum(n) AS BIGINT) AS guesses FROM g GROUP BY ALL),
c AS (SELECT label, coalesce(support, 0) AS support, coalesce(CAST(hits AS DOUBLE) / nullif(guesses, 0), 0) AS p, coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS r FROM a FULL JOIN b USING (label)),
e AS (SELECT label, support, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c)"""
_XY = "xy AS (SELECT segment_id, lower(zone) AS zone, latitude * 100 AS x, longitude * 100 AS y FROM dim_segment WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"

SQL = {
    "segment_profiles": f"WITH {_PROFILES} SELECT * FROM p",
    "rank_pct": f"WITH {_PROFILES} SELECT segment_id, round((rank() OVER (ORDER BY incident_total) + (count(*) OVER (PARTITION BY incident_total) - 1) / 2.0) / count(*) OVER (), 8) AS pct FROM p",
    "hourly_series": f"WITH {_SERIES} SELECT * FROM s",
    "supervised_lags": f"WITH {_LAGGED} SELECT CAST(strftime(timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, {', '.join(f"round({c}, {8 if c == 'roll_std_24' else 12}) AS {c}" for c in ['y', *_LAG_COLUMNS])} FROM f",
    "baseline_metrics": f"WITH {_LAGGED}, x AS (SELECT * FROM f ORDER BY timestamp DESC LIMIT {HORIZON}) {_METRIC.format(n='persistence', c='lag_1')} UNION ALL {_METRIC.format(n='seasonal_naive', c='lag_168')}",
    "itemsets": f"WITH {_SETS} SELECT itemset, size, n, support FROM named",
    "association_rules": f"WITH {_RULES} SELECT * FROM rules",
    "rule_explorer": f"WITH {_RULES} SELECT * FROM rules WHERE starts_with(consequent, 'SEVERITY=') ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent LIMIT 25",
    "severity_confusion": f"WITH {_GUESS} SELECT * FROM g",
    "severity_report": f"WITH {_CLASSES} SELECT label, support, round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1 FROM e",
    "severity_summary": f"""WITH {_CLASSES} SELECT 'accuracy' AS metric, round(CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS DOUBLE) / sum(n), 8) AS value FROM g UNION ALL SELECT 'macro_precision', round(avg(p), 8) FROM e
UNION ALL SELECT 'macro_recall', round(avg(r), 8) FROM e UNION ALL SELECT 'macro_f1', round(avg(f), 8) FROM e""",
    "rules_filtered": f"WITH {_RULES} SELECT * FROM rules WHERE confidence >= 0.7 AND lift >= 1.3 ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent LIMIT 200",
    "itemset_sizes": f"WITH {_SETS} SELECT size, count(*) AS n_sets FROM named GROUP BY ALL",
    "top_itemsets": f"WITH {_SETS} SELECT itemset, n, CASE WHEN length(itemset) >= 58 THEN substr(itemset, 1, 55) || '...' ELSE itemset END AS label FROM named ORDER BY n DESC, itemset LIMIT 25",
    "ordered_counts": """SELECT ['Minor', 'Moderate', 'Serious', 'Critical'][severity] AS severity_label, severity AS severity_order, day_name, CAST(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], day_name) - 1 AS INT) AS day_order, count(*) AS n
FROM fact_incident JOIN dim_time USING (time_key) WHERE severity BETWEEN 1 AND 4 GROUP BY ALL""",
    "measures_rules": f"WITH {_RULES} SELECT count(*) AS rules, max(lift) AS max_lift FROM rules",
    "measures_baselines": f"""WITH {_LAGGED}, x AS (SELECT * FROM f ORDER BY timestamp DESC LIMIT {HORIZON}), m AS (SELECT avg(abs(y - lag_168)) AS a, avg(abs(y - lag_1)) AS b FROM x)
SELECT round(a, 8) AS forecast_mae, round(b, 8) AS persistence_mae, round((b - a) / nullif(b, 0), 8) AS forecast_lift_pct FROM m""",
    "hotspot_segments": f"WITH {_PROFILES} SELECT segment_id, zone, mean_congestion, p95_congestion, incidents_per_1k FROM p ORDER BY mean_congestion DESC, segment_id LIMIT 10",
    "zone_names": f"""WITH {_PROFILES}, c AS (SELECT lower(zone) AS zone, count(*) AS segments, round(avg(mean_congestion), 4) AS m, round(avg(peak_ratio), 4) AS k, round(avg(incidents_per_1k), 4) AS i FROM p WHERE zone IS NOT NULL GROUP BY ALL),
r AS (SELECT *, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS q FROM c), th AS (SELECT quantile_cont(k, 0.5) AS k5, quantile_cont(k, 0.6) AS k6, quantile_cont(i, 0.75) AS i75 FROM c)
SELECT zone, segments, CASE WHEN q >= 0.75 AND k >= k5 THEN 'Chronic peak-hour bottleneck' WHEN q >= 0.75 THEN 'All-day saturated corridor' WHEN q >= 0.4 AND k >= k6 THEN 'Commuter-driven corridor' WHEN i >= i75 THEN 'Incident-prone but free-flowing' ELSE 'Stable low-stress segment' END AS label FROM r, th""",
    "dbscan_neighbours": f"WITH {_XY} SELECT a.segment_id, count(*) AS n_neighbours FROM xy a, xy b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 GROUP BY ALL",
    "dbscan_hotspots": f"""WITH RECURSIVE {_PROFILES}, b AS (SELECT segment_id, latitude AS x, longitude AS y, mean_congestion AS v FROM p JOIN dim_segment USING (segment_id) WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND mean_congestion IS NOT NULL),
q AS (SELECT segment_id, (x - (SELECT avg(x) FROM b)) / (SELECT stddev_pop(x) FROM b) AS x, (y - (SELECT avg(y) FROM b)) / (SELECT stddev_pop(y) FROM b) AS y, (v - (SELECT avg(v) FROM b)) / (SELECT stddev_pop(v) FROM b) AS v FROM b),
pr AS (SELECT i.segment_id AS a, j.segment_id AS b FROM q i, q j WHERE (i.x - j.x) ** 2 + (i.y - j.y) ** 2 + (i.v - j.v) ** 2 <= 0.65 * 0.65), cn AS (SELECT a, count(*) AS n FROM pr GROUP BY ALL), co AS (SELECT a FROM cn WHERE n >= 3),
re AS (SELECT a, a AS c FROM co UNION SELECT pr.b, re.c FROM re JOIN pr USING (a) WHERE pr.b IN (SELECT a FROM co)),
lb AS (SELECT a, min(c) AS c FROM re GROUP BY ALL), nu AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS cluster FROM (SELECT DISTINCT c FROM lb)),
bo AS (SELECT pr.a, min(lb.c) AS c FROM pr JOIN lb ON lb.a = pr.b GROUP BY ALL)
SELECT q.segment_id, cn.n AS n_neighbours, CAST(cn.n >= 3 AS INT) AS is_core, coalesce(nu.cluster, -1) AS cluster FROM q JOIN cn ON cn.a = q.segment_id LEFT JOIN bo ON bo.a = q.segment_id LEFT JOIN nu USING (c)""",
    "silhouette_zones": f"""WITH {_XY}, k AS (SELECT * FROM xy WHERE zone IS NOT NULL), n AS (SELECT zone, count(*) AS n FROM k GROUP BY ALL),
d AS (SELECT a.segment_id, a.zone AS own, b.zone AS other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS s FROM k a, k b GROUP BY ALL),
m AS (SELECT segment_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN n ON n.zone = d.other GROUP BY ALL)
SELECT segment_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 8) AS silhouette FROM m""",
    "stream_hourly_windows": "SELECT CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) AS hour_key, event_type, count(*) AS n FROM events GROUP BY ALL",
}
