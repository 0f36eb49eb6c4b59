"""Matching records of two tables by nearest time.

Both tables are cut by (entity, time bucket), right records near a bucket's edge
going to both sides, so that an entity of any size is spread over many tasks. The
rows of a task are sorted by Spark (which spills) and merged by one pass that
holds the right neighbours of the current left records only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["e", "b", "t", "id", "r"]


def _resolve(pdf: pd.DataFrame, tolerance: int, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Matches of the left rows whose neighbours are all known, and the rows to keep for what follows."""
    e, b, t, right = (pdf[c].to_numpy() for c in ("e", "b", "t", "r"))
    n = len(pdf)
    key = np.cumsum(np.r_[False, (e[1:] != e[:-1]) | (b[1:] != b[:-1])])
    rights = np.flatnonzero(right)
    if len(rights):  # of several right rows at one instant the first (smallest id) stays
        twin = np.r_[False, (key[rights[1:]] == key[rights[:-1]]) & (t[rights[1:]] == t[rights[:-1]])]
        rights = rights[~twin]
    lefts = np.flatnonzero(~right)
    at = np.searchsorted(rights, lefts)
    far = np.iinfo(np.int64).max

    def gap(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (pos >= 0) & (pos < len(rights))
        idx = rights[np.where(ok, pos, 0)] if len(rights) else np.zeros(len(pos), int)
        ok &= key[idx] == key[lefts]
        return np.where(ok, np.abs(t[idx] - t[lefts]), far), idx

    (before, i), (after, j) = gap(at - 1), gap(at)
    known = np.ones(len(lefts), bool)
    keep = pdf.iloc[:0]
    if not last and n:
        known = (after != far) | (key[lefts] != key[-1]) | (t[lefts] + tolerance < t[-1])
        own = rights[key[rights] == key[-1]]
        rows = np.r_[own[-1:], lefts[~known]]
        # a left row that still waits needs its own left neighbour too
        if (~known).any():
            first = at[~known].min() - 1
            rows = np.r_[own[own >= rights[max(first, 0)]] if len(rights) else own, lefts[~known]]
        keep = pdf.iloc[np.unique(rows)]
    take_before = before <= after
    best, idx = np.where(take_before, before, after), np.where(take_before, i, j)
    ok = known & (best <= tolerance)
    ids = pdf["id"].to_numpy(object)
    out = pd.DataFrame({"l": ids[lefts[ok]], "r": ids[idx[ok]], "d": (t[idx[ok]] - t[lefts[ok]]).astype(np.int64)})
    return out, keep


def merge_sorted(batches: Iterator[pd.DataFrame], tolerance: int) -> Iterator[pd.DataFrame]:
    """Streaming merge of rows sorted by (e, b, t, id); yields l, r, d (microseconds from left to right)."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        rows = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        out, held = _resolve(rows, tolerance, False)
        if len(out):
            yield out
    if held is not None and len(held):
        out, _ = _resolve(held.reset_index(drop=True), tolerance, True)
        if len(out):
            yield out


def match_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, entity: tuple[Column, Column], times: tuple[str, str], tolerance_s: float, bucket_s: float | None = None) -> DataFrame:
    """For each left record the right record of the same entity nearest in time, if within ``tolerance_s``.

    Returns ``left_id, right_id, seconds`` (right minus left). On a tie the
    earlier right record wins, then the smaller id. Records with a NULL entity,
    time or id match nothing; repeated left records give one row per distinct
    (id, entity, time). ``entity`` holds an expression on each side, so differing
    column names and extra columns do not matter. ``bucket_s`` (16 tolerances by
    default) sets how finely an entity is spread; about 2 * tolerance / bucket of
    the right rows are copied. Ids are compared as text.
    """
    tol = int(tolerance_s * 1_000_000)
    width = max(int((bucket_s or 16 * tolerance_s) * 1_000_000), 2 * tol, 1)
    side = lambda df, e, t, i: df.select(e.cast("bigint").alias("e"), F.unix_micros(F.col(t)).alias("t"), F.col(i).cast("string").alias("id")).dropna()
    lefts = side(left, entity[0], times[0], left_id).distinct().withColumns({"b": F.expr(f"t div {width}"), "r": F.lit(False)})
    span = F.expr(f"sequence((t - {tol}) div {width}, (t + {tol}) div {width})")
    rights = side(right, entity[1], times[1], right_id).select("e", "t", "id", F.explode(span).alias("b"), F.lit(True).alias("r"))
    rows = lefts.select(*COLUMNS).unionByName(rights.select(*COLUMNS)).repartition("e", "b").sortWithinPartitions("e", "b", "t", "id")
    kinds = (left.schema[left_id].dataType.simpleString(), right.schema[right_id].dataType.simpleString())
    out = rows.mapInPandas(lambda batches: merge_sorted(batches, tol), "l string, r string, d bigint")
    return out.select(F.col("l").cast(kinds[0]).alias(left_id), F.col("r").cast(kinds[1]).alias(right_id), (F.col("d") / 1e6).alias("seconds"))
