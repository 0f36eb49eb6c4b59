"""Clustering of entities: k-means sweep, quality indices, DBSCAN on a grid, PCA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcube.session import Scratch, cut

#: Points up to this number are held on every worker for exact silhouettes (8 bytes per number).
MAX_POINTS = 50_000


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z_<column> with the population deviation; constant columns give 0."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({f"z_{c}": (F.col(c) - (row[f"m{i}"] or 0.0)) / (row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def kmeans_best(df: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int]) -> tuple[DataFrame, list[np.ndarray], float]:
    """``df`` with ``cluster``, the centres and the inertia of the best of several starts."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df).persist()
    best = None
    for s in seeds:
        model = KMeans(k=k, seed=s, featuresCol="_x", predictionCol="cluster", maxIter=50).fit(rows)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    cost, model = best
    return model.transform(rows).drop("_x"), model.clusterCenters(), float(cost)


def _lloyd(x: np.ndarray, k: int, seed: int, max_iter: int = 300) -> tuple[float, np.ndarray]:
    """Inertia and centres of one greedy k-means++ start, run until no point changes its cluster."""
    rng = np.random.default_rng((seed, k))
    to = lambda c: ((x - c) ** 2).sum(1)
    centres = [x[rng.integers(len(x))]]
    near = to(centres[0])
    while len(centres) < k and near.sum() > 0:
        tried = [x[i] for i in rng.choice(len(x), 2 + int(np.log(k)), p=near / near.sum())]
        left = [np.minimum(near, to(c)) for c in tried]
        best = int(np.argmin([a.sum() for a in left]))
        centres.append(tried[best])
        near = left[best]
    cen, old = np.array(centres), None
    for _ in range(max_iter):
        d = np.stack([to(c) for c in cen], 1)
        lab = d.argmin(1)
        if old is not None and (lab == old).all():
            break
        old = lab
        cen = np.array([x[lab == j].mean(0) if (lab == j).any() else cen[j] for j in range(len(cen))])
    return float(np.stack([to(c) for c in cen], 1).min(1).sum()), cen


def kmeans_starts(df: DataFrame, columns: Sequence[str], starts: dict[int, int]) -> dict[int, tuple[float, np.ndarray]]:
    """``starts`` has the number of starts per k; inertia and centres of the best start of each k.

    Starts are spread over the workers, each of which holds all points; more than
    ``MAX_POINTS`` are refused. :func:`kmeans_best` takes more, start by start.
    """
    spark = df.sparkSession
    held = df.select(*columns).dropna().limit(MAX_POINTS + 1).toPandas().to_numpy(float)
    if len(held) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    if not len(held):
        return {}
    held = held[np.lexsort(held.T)]  # the same starts at every partitioning
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_lloyd(shared.value, k, s) for k, s in zip(pdf["k"], pdf["s"])]
            yield pd.DataFrame({"k": pdf["k"], "s": pdf["s"], "cost": [c for c, _ in got], "cen": [m.ravel().tolist() for _, m in got]})

    todo = spark.createDataFrame([(k, s) for k, n in starts.items() for s in range(n)], "k int, s int")
    tried = todo.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "k int, s int, cost double, cen array<double>")
    best = tried.groupBy("k").agg(F.min(F.struct("cost", "s", "cen")).alias("b")).collect()  # a row per k
    return {r.k: (r.b.cost, np.array(r.b.cen).reshape(-1, len(columns))) for r in best}


def _silhouette_sum(x: np.ndarray, lab: np.ndarray, a: int, b: int) -> float:
    """Sum of the Euclidean silhouettes of points a..b-1 (0 in clusters of one point)."""
    member = np.eye(int(lab.max()) + 1)[lab]
    size = member.sum(0)
    total = 0.0
    for i in range(a, b, 256):
        p, o = x[i : min(i + 256, b)], lab[i : min(i + 256, b)]
        d = np.sqrt(np.maximum(((p[:, None] - x[None]) ** 2).sum(2), 0)) @ member
        r = np.arange(len(p))
        mine = d[r, o] / np.maximum(size[o] - 1, 1)
        other = np.where(size > 0, d / np.maximum(size, 1), np.inf)
        other[r, o] = np.inf
        other = other.min(1)
        with np.errstate(invalid="ignore"):
            s = np.where(np.isfinite(other), (other - mine) / np.maximum(other, mine), 0.0)
        total += float(np.where(size[o] > 1, np.nan_to_num(s), 0.0).sum())
    return total


def kmeans_sweep(df: DataFrame, columns: Sequence[str], starts: dict[int, int]) -> dict[int, tuple[float, np.ndarray, float]]:
    """:func:`kmeans_starts`, with the mean silhouette of each k's best start; blocks of points are scored over the workers."""
    best = kmeans_starts(df, columns, starts)
    if not best:
        return {}
    spark = df.sparkSession
    x = df.select(*columns).dropna().toPandas().to_numpy(float)  # counted to be few by kmeans_starts
    labels = {k: ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) for k, (_, c) in best.items()} if len(x) * max(best) < 5_000_000 else {k: np.concatenate([((x[i : i + 4096, None] - c[None]) ** 2).sum(2).argmin(1) for i in range(0, len(x), 4096)]) for k, (_, c) in best.items()}
    shared = spark.sparkContext.broadcast((x, labels))
    step = max(256, -(-len(x) // (4 * spark.sparkContext.defaultParallelism)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, lab = shared.value
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "s": [_silhouette_sum(points, lab[k], a, b) for k, a, b in zip(pdf["k"], pdf["a"], pdf["b"], strict=True)]})

    todo = [(k, a, min(a + step, len(x))) for k in best for a in range(0, len(x), step)]
    got = spark.createDataFrame(todo, "k int, a int, b int").repartition(min(len(todo), spark.sparkContext.defaultParallelism)).mapInPandas(score, "k int, s double")
    mean = {r.k: r.s / len(x) for r in got.groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return {k: (cost, c, mean[k]) for k, (cost, c) in best.items()}


def nearest_centre(df: DataFrame, columns: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Adds the number of the nearest centre; ties go to the first."""
    d = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, m)), F.lit(0.0)) for m in centres]
    return df.withColumn(name, F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)]))["i"])


def silhouettes(df: DataFrame, key: str, columns: Sequence[str], cluster: str) -> DataFrame:
    """Euclidean silhouette of each point: ``key, cluster, silhouette`` (0 in clusters of one point).

    Rows are scored in blocks against all points, which every worker holds; more
    than ``MAX_POINTS`` points are refused.
    """
    points = df.select(key, cluster, *columns).dropna()
    held = points.limit(MAX_POINTS + 1).toPandas()
    if len(held) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    x, lab = held[list(columns)].to_numpy(float), held[cluster].to_numpy()
    names, code = np.unique(lab, return_inverse=True)
    member = np.eye(len(names))[code]
    size = member.sum(0)
    shared = points.sparkSession.sparkContext.broadcast((x, names, member, size))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, names, member, size = shared.value
        for pdf in batches:
            p = pdf[list(columns)].to_numpy(float)
            own = np.searchsorted(names, pdf[cluster].to_numpy())
            out = np.empty(len(p))
            for a in range(0, len(p), 256):
                d = np.sqrt(np.maximum(((p[a : a + 256, None, :] - x[None]) ** 2).sum(2), 0)) @ member
                o, r = own[a : a + 256], np.arange(len(d))
                mine = d[r, o] / np.maximum(size[o] - 1, 1)
                other = d / size
                other[r, o] = np.inf
                other = other.min(1) if len(size) > 1 else np.full(len(d), np.nan)
                s = (other - mine) / np.maximum(other, mine)
                out[a : a + 256] = np.where(size[o] > 1, s, 0.0)
            yield pd.DataFrame({key: pdf[key], cluster: pdf[cluster], "silhouette": out})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.mapInPandas(score, f"`{key}` {kinds[key]}, `{cluster}` {kinds[cluster]}, silhouette double")


def cluster_indices(df: DataFrame, columns: Sequence[str], cluster: str) -> dict[str, float]:
    """Inertia, Davies-Bouldin and Calinski-Harabasz from per-cluster aggregates (one small row per cluster)."""
    cents = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns])
    sq = sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in columns), F.lit(0.0))
    rows = df.join(F.broadcast(cents), cluster).groupBy(cluster).agg(F.first("n").alias("n"), F.sum(sq).alias("ss"), F.avg(F.sqrt(sq)).alias("s"), *[F.first(f"c_{c}").alias(f"c_{c}") for c in columns])
    got = rows.toPandas()
    cen, n = got[[f"c_{c}" for c in columns]].to_numpy(float), got["n"].to_numpy(float)
    k, total, inertia = len(got), n.sum(), float(got["ss"].sum())
    mean = (cen * n[:, None]).sum(0) / total
    between = float((n * ((cen - mean) ** 2).sum(1)).sum())
    d = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    s = got["s"].to_numpy(float)
    db = float(((s[:, None] + s[None]) / d).max(1).mean()) if k > 1 else float("nan")
    ch = between / (k - 1) / (inertia / (total - k)) if k > 1 and total > k and inertia else float("nan")
    return {"inertia": inertia, "davies_bouldin": float(db), "calinski_harabasz": float(ch)}


def neighbour_pairs(df: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """Pairs (a, b) at distance <= eps (a = b included): points meet only within neighbouring grid cells of width eps."""
    cell = [F.floor(F.col(c) / eps).cast("bigint").alias(f"g{i}") for i, c in enumerate(columns)]
    a = df.select(F.col(key).alias("a"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(columns)], *cell)
    b = df.select(F.col(key).alias("b"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(columns)], *cell)
    for i in range(len(columns)):
        b = b.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + d for d in (-1, 0, 1)])))
    d2 = sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(len(columns))), F.lit(0.0))
    return a.join(b, [f"g{i}" for i in range(len(columns))]).where(d2 <= eps * eps).select("a", "b")


def _components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (k, c) with the smallest key of each component in c."""
    scratch = Scratch(links.sparkSession)
    try:
        while True:
            ends = links.join(labels.select(F.col("k").alias("a"), F.col("c").alias("_c")), "a").join(labels.select(F.col("k").alias("b"), F.col("c").alias("_p")), "b")
            hooks = scratch.write(ends.where("_p < _c").groupBy("_c").agg(F.min("_p").alias("_p")))
            if hooks.isEmpty():
                return cut(labels)
            further = hooks.select(F.col("_c").alias("_p"), F.col("_p").alias("_q"))
            hooks = hooks.join(further, "_p", "left").select(F.col("_c").alias("c"), F.coalesce("_q", "_p").alias("_new"))
            moved = scratch.write(labels.join(hooks, "c", "left").select("k", F.coalesce("_new", "c").alias("c")))
            ahead = moved.select(F.col("k").alias("c"), F.col("c").alias("_c"))
            labels = scratch.write(moved.join(ahead, "c").select("k", F.col("_c").alias("c")))
    finally:
        scratch.remove()


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """``key, n_neighbours, is_core, cluster``; noise has cluster -1, a border point the smallest cluster it touches.

    Clusters are connected components of core points: in rounds, every component
    hooks onto the smallest one it touches and every point follows its label's
    label, which halves long chains, until none touches a smaller one. A cluster's number is the rank of its smallest key.
    NULL coordinates are noise.
    """
    points = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    pairs = cut(neighbour_pairs(points, key, columns, eps))
    counts = cut(pairs.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("n")))
    core = counts.where(F.col("n") >= min_points).select("k")
    links = cut(pairs.join(core.withColumnRenamed("k", "a"), "a", "left_semi").join(core.withColumnRenamed("k", "b"), "b", "left_semi"))
    labels = _components(links, cut(core.select("k", F.col("k").alias("c"))))
    border = pairs.join(labels.select(F.col("k").alias("b"), "c"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("c"))
    # one row per cluster, so that one task can number them
    numbers = labels.select("c").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("c")) - 1)
    out = df.select(F.col(key).alias("k")).join(counts, "k", "left").join(border, "k", "left").join(numbers, "c", "left")
    return out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).alias("n_neighbours"), F.coalesce((F.col("n") >= min_points).cast("int"), F.lit(0)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def pca_plane(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, pc1, pc2`` of standardised columns; each axis is turned so that its largest loading is positive."""
    z = standardise(df, columns)
    rows = VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="_x", handleInvalid="skip").transform(z)
    model = PCA(k=2, inputCol="_x", outputCol="_p").fit(rows)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    p = vector_to_array("_p")
    return model.transform(rows).select(key, (p[0] * sign[0]).alias("pc1"), (p[1] * sign[1]).alias("pc2"))
