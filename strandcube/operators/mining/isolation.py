"""Isolation forest: trees on bounded subsamples, scoring by column expressions over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _depth(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length at a leaf) of one tree."""
    nodes: list = []

    def split(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append(None)
        lo, hi = x[rows].min(0), x[rows].max(0)
        live = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) < 2 or not len(live):
            nodes[me] = (-1, 0.0, -1, -1, level + _depth(len(rows)))
            return me
        f = int(rng.choice(live))
        at = float(rng.uniform(lo[f], hi[f]))
        left = rows[x[rows, f] < at]
        right = rows[x[rows, f] >= at]
        a = split(left, level + 1) if len(left) else -1
        b = split(right, level + 1)
        nodes[me] = (f, at, a if a >= 0 else b, b, 0.0)
        return me

    split(np.arange(len(x)), 0)
    return nodes


def _heap(nodes: list, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a full binary one: feature and cut of the inner places, path length of the last level's; leaves lead left to it."""
    f, cut, length = np.zeros(2**limit - 1, int), np.full(2**limit - 1, np.inf), np.zeros(2**limit)

    def place(i: int, at: int, level: int) -> None:
        feature, c, left, right, n = nodes[i]
        if feature < 0:
            length[((at + 1) << (limit - level)) - 2**limit] = n
            return
        f[at], cut[at] = feature, c
        place(left, 2 * at + 1, level + 1)
        place(right, 2 * at + 2, level + 1)

    place(0, 0, 0)
    return f, cut, length


class IsolationForest:
    def __init__(self, trees: int = 200, subsample: int = 256, seed: int = 42) -> None:
        self.trees, self.subsample, self.seed = trees, subsample, seed

    def fit(self, df: DataFrame, columns: Sequence[str], key: str) -> IsolationForest:
        """Grow each tree on its own ``subsample`` of all complete rows, dealt in the order of a hash.

        Tables of fewer rows than all trees take together give each tree a draw from all rows.
        """
        want = self.trees * self.subsample
        rows = df.select(*columns, F.xxhash64(F.col(key), F.lit(self.seed)).alias("_h")).dropna()
        total = rows.count()
        share = min(1.0, (1.2 * want + 100) / max(total, 1))
        pool = rows.where(F.pmod("_h", F.lit(1_000_000_000)) < int(share * 1_000_000_000) + 1).orderBy(F.pmod("_h", F.lit(1_000_000_000)), "_h").limit(want)
        x = pool.select(*columns).toPandas().to_numpy(float)
        self.columns = list(columns)
        rng = np.random.default_rng(self.seed)
        n = min(self.subsample, len(x))
        self.limit = max(1, math.ceil(math.log2(max(n, 2))))
        dealt = rng.permutation(len(x)).reshape(self.trees, -1) if len(x) == want and n else [rng.choice(len(x), n, replace=False) for _ in range(self.trees if n else 0)]
        self.forest = [_heap(_grow(x[i], rng, self.limit), self.limit) for i in dealt]
        self.norm = max(_depth(n), 1e-9)
        return self

    def _score(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        depth, flat, row = np.zeros(n), x.T.ravel(), np.arange(n)
        for f, cut, length in self.forest:
            at, start = np.zeros(n, int), f * n
            for _ in range(self.limit):
                at = 2 * at + 1 + (flat[start[at] + row] >= cut[at])
            depth += length[at - len(cut)]
        return -(2.0 ** (-depth / max(len(self.forest), 1) / self.norm))

    def transform(self, df: DataFrame, out: str = "iso_score") -> DataFrame:
        """Adds the score (lower is more abnormal); rows with NULLs get NULL."""
        columns, shared = self.columns, df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                s = shared.value._score(np.nan_to_num(x))
                yield pd.Series(np.where(np.isnan(x).any(1), np.nan, s))

        s = score(*[F.col(c) for c in columns])
        return df.withColumn("_s", s).withColumn(out, F.when(~F.isnan("_s"), F.col("_s"))).drop("_s")
