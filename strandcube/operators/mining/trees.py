"""Forests and boosted trees that grow whole within a task, over all rows at one byte a feature.

The rows are binned once (at most ``BINS`` bins a feature) and packed into blocks.
Each task of a forest gets all blocks and grows its share of the trees level by
level: one histogram over the rows and the drawn features of all open nodes of a
level, of which only the bins that a feature has are kept. Trees stay in the shared
folder; rows are scored by the task that holds the trees, and the votes are added.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.session import cut

BINS, TASKS = 32, 12
#: Rows beyond which a forest is grown by rows (MLlib) instead: a task holds all of them at one byte a feature.
GROW_ROWS = 1_500_000
_BLOCK = "part int, seq int, n int, y binary, codes binary"

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature, cut, first child (a leaf's is itself), value


def find_edges(rows: DataFrame) -> list[np.ndarray]:
    """Cuts of each place of ``_x``: its distinct values if they are few, else equal shares of the rows."""
    attrs = rows.schema["_x"].metadata["ml_attr"]
    binary = {a["idx"] for a in attrs["attrs"].get("binary", [])}
    wide = [i for i in range(attrs["num_attrs"]) if i not in binary]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(wide, pa.int32()), pa.array([x[:, i].tobytes() for i in wide], pa.binary())], names=["place", "x"])

    def cuts(found: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.concatenate([np.frombuffer(b, np.float64) for b in found.x]))
        few = np.unique(x)
        few = few if len(few) < BINS else np.unique(x[-(-len(x) * np.arange(1, BINS) // BINS) - 1])
        return pd.DataFrame({"place": [int(found.place.iloc[0])], "cuts": [few.tolist()]})

    out = [np.zeros(1)] * attrs["num_attrs"]
    if wide:
        parts = rows.select(vector_to_array("_x").alias("_a")).mapInArrow(values, "place int, x binary")
        for r in parts.groupBy("place").applyInPandas(cuts, "place int, cuts array<double>").collect():
            out[r.place] = np.array(r.cuts)
    return out


def blocks(rows: DataFrame, edges: Sequence[np.ndarray], y: str) -> DataFrame:
    """The rows of each Arrow batch as one row: bin numbers (features x rows) and the column ``y`` as bytes."""
    kind = np.int64 if rows.schema[y].dataType.simpleString() == "bigint" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)
            key = b.column(1).to_numpy(zero_copy_only=False).astype(kind)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([b.num_rows], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n", "y", "codes"])

    return rows.select(vector_to_array("_x").alias("_a"), F.col(y).alias("_y")).mapInArrow(pack, _BLOCK)


def _unpacked(found: pd.DataFrame, places: int) -> tuple[np.ndarray, np.ndarray]:
    found = found.sort_values(["part", "seq"])
    codes = [np.frombuffer(c, np.uint8).reshape(places, n) for c, n in zip(found.codes, found.n, strict=True)]
    return np.concatenate(codes, axis=1), np.concatenate([np.frombuffer(b, np.float64) for b in found.y])


def grow(codes: np.ndarray, sizes: np.ndarray, y: np.ndarray, times: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int, weights: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """One tree and the gain of each feature.

    ``codes`` are bin numbers (features x rows), of which feature f has ``sizes[f]``;
    a row counts ``times`` times. With ``weights`` (one per class) ``y`` are classes
    and ``codes`` hold ``bin * classes + y``; without, ``y`` are numbers and leaves are means.
    Leaves hold at least ``least`` rows; a node tries ``tries`` features drawn for it.
    """
    places, n = codes.shape
    flat, k = codes.ravel(), 1 if weights is None else len(weights)
    at = np.flatnonzero(times)
    count, gains, levels, first = np.array([len(at)]), np.zeros(places), [], 0
    for level in range(depth + 1):
        m, a = times[at], len(count)
        node = np.repeat(np.arange(a), count)
        if weights is None:
            total = np.stack([np.bincount(node, m, a), np.bincount(node, m * y[at], a)], 1)
            size, value, mixed = total[:, 0], total[:, 1:] / np.maximum(total[:, :1], 1), np.full(a, True)
        else:
            total = np.bincount(node * k + y[at].astype(np.int64), m, a * k).reshape(a, k)
            size, mixed, w = total.sum(1), (total > 0).sum(1) > 1, total * weights
            value = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        feature, cutoff, child = np.zeros(a, np.int64), np.full(a, 32767, np.int16), first + np.arange(a)
        levels.append((feature, cutoff, child, value))
        open_ = np.flatnonzero(mixed & (size >= 2 * least)) if level < depth else np.empty(0, int)
        if not len(open_):
            break
        if len(open_) < a:
            keep = np.zeros(a, bool)
            keep[open_] = True
            keep = keep[node]
            at, m, count, total = at[keep], m[keep], count[open_], total[open_]
        o = len(open_)
        drawn = np.argpartition(rng.random((o, places)), tries - 1, 1)[:, :tries] if tries < places else np.tile(np.arange(places), (o, 1))
        cells = sizes[drawn]
        start = np.cumsum(cells.ravel()) - cells.ravel()
        n_cells = int(cells.sum())
        from_, base = (start * k).reshape(o, tries), drawn * n
        key, rows = np.empty(tries * len(at), np.int64), len(at)
        for j in range(tries):
            where, into = np.repeat(base[:, j], count), key[j * rows : (j + 1) * rows]
            where += at
            into[:] = np.repeat(from_[:, j], count)
            into += flat[where]
        if weights is None:
            h = np.stack([np.bincount(key, np.tile(m, tries), n_cells), np.bincount(key, np.tile(m * y[at], tries), n_cells)])
        else:
            h = np.ascontiguousarray(np.bincount(key, np.tile(m, tries), n_cells * k).reshape(n_cells, k).T)
        owner = np.repeat(np.arange(o), cells.sum(1))
        run = np.zeros((len(h), n_cells + 1))
        np.cumsum(h, 1, out=run[:, 1:])
        left, all_ = run[:, 1:] - np.repeat(run[:, start], cells.ravel(), 1), total.T[:, owner]
        n_left, n_all = (left[0], all_[0]) if weights is None else (left.sum(0), size[open_][owner])
        ok = np.flatnonzero((n_left >= least) & (n_all - n_left >= least))
        score = np.full(n_cells, -np.inf)
        lo, hi = left[:, ok], all_[:, ok] - left[:, ok]
        if weights is None:
            score[ok] = lo[1] ** 2 / lo[0] + hi[1] ** 2 / hi[0]
            parent, scale = total[:, 1] ** 2 / total[:, 0], np.abs(total[:, 1])
        else:
            lo, hi, w = lo * weights[:, None], hi * weights[:, None], total * weights
            score[ok] = (lo * lo).sum(0) / lo.sum(0) + (hi * hi).sum(0) / hi.sum(0)
            parent, scale = (w * w).sum(1) / w.sum(1), w.sum(1)
        most = np.maximum.reduceat(score, start.reshape(o, tries)[:, 0])
        hit = np.flatnonzero(score == most[owner])
        best = hit[np.searchsorted(owner[hit], np.arange(o))]
        gain = most - parent
        split = gain > 1e-10 * np.maximum(scale, 1e-300)
        place = np.searchsorted(start, best, "right") - 1
        f, c = drawn.ravel()[place], best - start[place]
        np.add.at(gains, f[split], gain[split])
        mine, new = open_[split], np.arange(int(split.sum()))
        feature[mine], cutoff[mine], child[mine] = f[split], c[split], first + a + 2 * new
        if not len(new):
            break
        keep = np.repeat(split, count)
        at, count = at[keep], count[split]
        to = np.repeat(2 * new, count) + (flat[np.repeat(f[split] * n, count) + at] > np.repeat(c[split] * k + k - 1, count))
        at = at[np.argsort(to.astype(np.uint16) if 2 * len(new) < 65536 else to, kind="stable")]
        count, first = np.bincount(to, minlength=2 * len(new)), first + a
    feature, cutoff, child, value = (np.concatenate(x) for x in zip(*levels, strict=True))
    return (feature.astype(np.uint16), cutoff, child.astype(np.int32), value.astype(np.float32 if weights is not None else float)), gains


def reached(tree: Tree, codes: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each row; ``codes`` are bin numbers."""
    n = codes.shape[1]
    flat, row, at = codes.ravel(), np.arange(n), np.zeros(n, np.int64)
    feature, cutoff, child, _ = tree
    base = feature.astype(np.int64) * n
    for _ in range(depth):
        at = child[at] + (flat[base[at] + row] > cutoff[at])
    return at


class GrownModel(Model):
    """Trees in the shared folder (``task, trees``); predicts the class of most votes, or the weighted sum of the trees' numbers."""

    def __init__(self, trees: DataFrame, edges: Sequence[np.ndarray], depth: int, classes: int, gains: np.ndarray) -> None:
        super().__init__()
        self.trees, self.edges, self.depth, self.classes, self.prediction = trees, list(edges), depth, classes, "prediction"
        self.featureImportances: DenseVector = Vectors.dense(gains)

    def setPredictionCol(self, name: str) -> GrownModel:
        self.prediction = name
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        depth, places, classes = self.depth, len(self.edges), self.classes
        k = max(classes, 1)
        rows = cut(dataset.withColumn("_row", F.monotonically_increasing_id()))

        def vote(held: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
            group = [t for blob in grown.trees for t in pickle.loads(blob)]
            out = []
            for b in held.itertuples():
                codes, sums = np.frombuffer(b.codes, np.uint8).reshape(places, b.n), np.zeros((b.n, k))
                for tree, weight in group:
                    sums += tree[3][reached(tree, codes, depth)] * weight
                out.append(sums.tobytes())
            return held[["part", "seq", "y"]].assign(votes=out)

        def add(votes: pd.DataFrame) -> pd.DataFrame:
            sums = sum(np.frombuffer(v, np.float64).reshape(-1, k) for v in votes.votes)
            return pd.DataFrame({"_row": np.frombuffer(votes.y.iloc[0], np.int64), "_p": sums.argmax(1).astype(float) if classes else sums[:, 0]})

        tasks = F.explode(F.array(*[F.lit(t) for t in range(self.trees._counted)])).alias("task")
        held = blocks(rows, self.edges, "_row").select("*", tasks)
        votes = held.groupBy("task").cogroup(self.trees.select("task", "trees").groupBy("task")).applyInPandas(vote, "part int, seq int, y binary, votes binary")
        found = votes.groupBy("part", "seq").applyInPandas(add, "_row bigint, _p double")
        return rows.join(found, "_row").drop("_row").withColumnRenamed("_p", self.prediction)


def _fitted(rows: DataFrame, y: str, edges: list[np.ndarray], depth: int, classes: int, tasks: int, make: Callable[[int, np.ndarray, np.ndarray], tuple[list, list[np.ndarray]]]) -> GrownModel:
    """``make`` gets the number of a task, the codes and y, and gives (tree, weight) pairs and the gains of each tree."""
    places = len(edges)

    def task(found: pd.DataFrame) -> pd.DataFrame:
        codes, target = _unpacked(found, places)
        trees, gains = make(int(found.task.iloc[0]), codes, target)
        each = [g / g.sum() for g in gains if g.sum() > 0]
        return pd.DataFrame({"task": [int(found.task.iloc[0])], "trees": [pickle.dumps(trees)], "gains": [list(map(float, sum(each, np.zeros(places))))]})

    copies = cut(blocks(rows, edges, y)).select("*", F.explode(F.array(*[F.lit(t) for t in range(tasks)])).alias("task"))
    copies = copies.repartitionByRange(tasks, "task") if tasks > 1 else copies
    grown = cut(copies.groupBy("task").applyInPandas(task, "task int, trees binary, gains array<double>"))
    gains = np.sum([r.gains for r in grown.select("gains").collect()], 0) if grown._counted else np.zeros(places)
    return GrownModel(grown, edges, depth, classes, gains / (gains.sum() or 1.0))


def fit_forest(rows: DataFrame, y: str, trees: int, depth: int, least: int, tries: int | None = None, weights: Sequence[float] | None = None, seed: int = 42) -> GrownModel:
    """A forest over ``_x``, each tree over its own bootstrap of all rows; classes 0, 1, ... if their ``weights`` are given, else numbers.

    ``tries``: features drawn for each node (by default the root of their number, rounded up, for classes and all for numbers).
    """
    edges = find_edges(rows)
    sizes, tasks = np.array([len(e) + 1 for e in edges]), min(TASKS, trees)
    w = None if weights is None else np.array(weights, float)
    drawn = tries or (len(edges) if w is None else int(np.ceil(len(edges) ** 0.5)))

    def make(task: int, codes: np.ndarray, target: np.ndarray) -> tuple[list, list[np.ndarray]]:
        if w is not None:
            codes = codes.astype(np.uint8 if BINS * len(w) <= 256 else np.uint16) * len(w) + target.astype(np.uint8)
        out, gains = [], []
        for t in range(task, trees, tasks):
            rng = np.random.default_rng([seed, t])
            times = np.bincount(rng.integers(0, len(target), len(target)), minlength=len(target)).astype(float)
            tree, gain = grow(codes, sizes, target, times, rng, depth, least, drawn, w)
            out.append((tree, 1.0 / trees))
            gains.append(gain)
        return out, gains

    return _fitted(rows, y, edges, depth, 0 if w is None else len(w), tasks, make)


def fit_boosting(rows: DataFrame, y: str, rounds: int, depth: int, step: float, seed: int = 42) -> GrownModel:
    """Boosted trees for squared error over ``_x``, as MLlib's: the first tree at weight 1, each other one fitted to twice the residuals at weight ``step``."""
    edges = find_edges(rows)
    sizes = np.array([len(e) + 1 for e in edges])

    def make(_: int, codes: np.ndarray, target: np.ndarray) -> tuple[list, list[np.ndarray]]:
        out, gains, rng, guess = [], [], np.random.default_rng(seed), np.zeros(len(target))
        for r in range(rounds):
            tree, gain = grow(codes, sizes, 2 * (target - guess) if r else target, np.ones(len(target)), rng, depth, 1, len(edges))
            weight = step if r else 1.0
            guess += weight * tree[3][reached(tree, codes, depth), 0]
            out.append((tree, weight))
            gains.append(gain)
        return out, gains

    return _fitted(rows, y, edges, depth, 0, 1, make)
