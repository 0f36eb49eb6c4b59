"""Filling containers of fixed capacity: cost-balanced packing.

The cost of a text of n tokens is linear plus quadratic in n, as attention is.
Texts in descending order go to the container of lowest cost that still has room
for them, at first among the containers that they would nearly fill; the number of
containers starts at the least that could do and grows only when nothing has room. Texts are packed within buckets of a bounded number
of texts, so containers are made in parallel and each bucket wastes at most a
little.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.session import cut, parallelism

#: Container ids are bucket * STRIDE + number within the bucket.
STRIDE = 1 << 32


@dataclass(frozen=True)
class Cost:
    """Cost of n tokens: ``linear * n + quadratic * n * n``."""

    linear: float = 1.0
    quadratic: float = 1.0 / 2048

    def of(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


class _Room:
    """Open containers by room left; finds the cheapest with room for n in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _update(self, room: int) -> None:
        h = self.heaps.get(room)
        i = room + self.size
        best = self.best
        best[i] = h[0] if h else None
        i >>= 1
        while i:
            a, b = best[2 * i], best[2 * i + 1]
            new = a if b is None or (a is not None and a <= b) else b
            if best[i] == new:
                break
            best[i] = new
            i >>= 1

    def put(self, room: int, cost: float, number: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, number))
        self._update(room)

    def cheapest(self, n: int, slack: int | None = None) -> tuple[float, int] | None:
        """The cheapest container with room for ``n``; with ``slack``, of those that would then have at most so much left."""
        lo, hi, found = n + self.size, 2 * self.size if slack is None else min(n + slack + 1, self.size) + self.size, None
        while lo < hi:
            if lo & 1:
                x = self.best[lo]
                if x is not None and (found is None or x < found):
                    found = x
                lo += 1
            if hi & 1:
                hi -= 1
                x = self.best[hi]
                if x is not None and (found is None or x < found):
                    found = x
            lo >>= 1
            hi >>= 1
        return found

    def take(self, room: int) -> None:
        heapq.heappop(self.heaps[room])
        self._update(room)


#: Share of the capacity below which a container counts as nearly full.
SLACK = 1 / 12


def assign(sizes: np.ndarray, capacity: int, cost: Cost, containers: int | None = None) -> np.ndarray:
    """Container number of each size (all <= capacity, sorted falling): the cheapest open one with room, first of those it would nearly fill.

    ``containers`` are open from the start (by default the least number that could hold everything).
    """
    slack = int(capacity * SLACK)
    total = int(sizes.sum())
    k = containers if containers is not None else least_containers(sizes, capacity)
    room = _Room(capacity)
    left = [capacity] * k
    if k:
        room.heaps[capacity] = [(0.0, i) for i in range(k)]
        room._update(capacity)
    out = np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        got = (room.cheapest(n, slack) or room.cheapest(n)) if k else None
        if got is None:
            spent, c = 0.0, k
            k += 1
            left.append(capacity)
        else:
            spent, c = got
            room.take(left[c])
        left[c] -= n
        room.put(left[c], spent + cost.of(n), c)
        out[i] = c
    assert total == capacity * k - sum(left)
    return out


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the containers needed: by volume, and by sizes of which no two fit together (for each threshold)."""
    if not len(sizes):
        return 0
    bound = -(-int(sizes.sum()) // capacity)
    up = np.sort(sizes)
    run = np.r_[0, np.cumsum(up)]
    for a in range(0, capacity // 2 + 1, max(1, capacity // 64)):
        # sizes over capacity - a stand alone against sizes of at least a; those over a half each need their own
        i, j, h = np.searchsorted(up, [a, capacity - a, capacity // 2], side="right")
        alone, large = len(up) - j, max(j - h, 0)
        middle = int(run[h] - run[min(np.searchsorted(up, a, side="left"), h)])
        slack = large * capacity - int(run[j] - run[h])
        bound = max(bound, alone + large + max(0, -(-(middle - slack) // capacity)))
    return bound


def pack_bucket(ids: Sequence, tokens: np.ndarray, capacities: Sequence[tuple[str, int]], cost: Cost) -> pd.DataFrame:
    """All pieces of one bucket for each capacity: id, container_name, number, piece, start, n_tokens, order within the container."""
    ids = np.asarray(ids, object)
    frames = []
    for name, cap in capacities:
        whole, rest = tokens // cap, tokens % cap
        split = tokens > cap
        full = np.where(split, whole, 0)
        last = np.where(split, rest, tokens)
        has_last = (last > 0) | ~split
        # full pieces fill a container each
        at = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        items = np.flatnonzero(has_last)
        items = items[np.lexsort((items, -last[items]))]
        number = assign(last[items], cap, cost)
        made = int(number.max(initial=-1)) + 1
        doc = np.r_[at, items]
        n = np.r_[np.full(len(at), cap), last[items]]
        pieces = np.r_[piece, full[items]]
        frames.append(pd.DataFrame({"id": ids[doc], "container_name": name, "number": np.r_[made + np.arange(len(at)), number], "piece": pieces, "start": pieces * cap, "n_tokens": n}))
    return pd.concat(frames) if frames else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id", "container_name", "number", "piece", "start", "n_tokens")})


def pack(sizes: DataFrame, item: str, tokens: str, capacities: Sequence[tuple[str, int]], cost: Cost | None = None, bucket_items: int = 16_384) -> DataFrame:
    """Assign items to containers of each capacity.

    Returns ``item, container_name, container_id, piece_no, token_start,
    n_tokens``: one row per piece. Only items larger than the capacity are cut,
    into full containers and a rest that is packed like an item. Items without
    tokens (NULL counts as 0) take no room and are still assigned. Repeated rows
    are separate items. Buckets hold about ``bucket_items`` items, whatever their
    ids; ties of size go by position within the bucket after sorting by id.
    Empty input gives no rows.
    """
    c = cost or Cost()
    caps = [(str(n), int(k)) for n, k in capacities]
    if any(k < 1 for _, k in caps):
        raise ValueError("capacities are positive numbers of tokens")
    rows = cut(sizes.select(F.col(item).alias("id"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n")))
    buckets = max(1, -(-rows.count() // bucket_items))
    # Sizes are few bytes and much work: the number of tasks is set here, not by their volume.
    tasks = min(buckets, 4 * parallelism(sizes.sparkSession))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("bigint")).repartition(tasks, "bucket")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        out = pack_bucket(pdf["id"].tolist(), pdf["n"].to_numpy(np.int64), caps, c)
        out["container_id"] = out.pop("number").astype(np.int64) + int(pdf["bucket"].iloc[0]) * STRIDE
        return out[["id", "container_name", "container_id", "piece", "start", "n_tokens"]]

    kind = sizes.schema[item].dataType.simpleString()
    out = rows.groupBy("bucket").applyInPandas(run, f"id {kind}, container_name string, container_id bigint, piece int, start bigint, n_tokens bigint")
    return out.select(F.col("id").alias(item), "container_name", "container_id", F.col("piece").alias("piece_no"), F.col("start").alias("token_start"), "n_tokens")


def packing_report(packed: DataFrame, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """Containers, pieces, tokens and the used share of the room per container kind."""
    caps = F.create_map(*[F.lit(x) for n, k in capacities for x in (str(n), int(k))])
    out = packed.groupBy("container_name").agg(
        F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    return out.withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * caps[F.col("container_name")]))
